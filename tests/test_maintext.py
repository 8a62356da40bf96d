"""Main text of pages of many shapes."""

import random

from docloom.functions import html as H
from docloom.functions.maintext import main_text

SENTENCE = "A paragraph of some length, with clauses, says what the page is about and why it matters."


def page(body: str) -> str:
    return f"<!doctype html><html><head><title>T</title><script>x('<p>no</p>')</script></head><body>{body}</body></html>"


def test_boilerplate_goes_and_content_stays():
    nav = "<nav><ul>" + "".join(f"<li><a href='/{i}'>A link with some words {i}</a></li>" for i in range(20)) + "</ul></nav>"
    body = f"{nav}<div class='ad wide'>{SENTENCE}</div><article><h1>Head</h1><p>{SENTENCE}</p><p>{SENTENCE} <a href='x'>More</a>.</p></article><footer>{SENTENCE}</footer>"
    assert main_text(page(body)) == f"Head\n{SENTENCE}\n{SENTENCE} More."


def test_content_in_plain_divs_between_sidebars():
    links = "".join(f"<p><a href='{i}'>Read this other interesting story number {i} on our site</a></p>" for i in range(30))
    body = f"<div id='left'>{links}</div><div id='mid'><div>{''.join(f'<p>{SENTENCE} {i}</p>' for i in range(6))}</div></div><div class='side-bar related'>{SENTENCE}</div>"
    assert main_text(page(body)).split("\n") == [f"{SENTENCE} {i}" for i in range(6)]


def test_sections_of_one_text_stay_together():
    sections = "".join(f"<section><h2>Part {i}</h2><p>{SENTENCE} {i}</p><p>{SENTENCE}</p></section>" for i in range(5))
    text = main_text(page(f"<div class='menu'>x</div><main>{sections}</main>"))
    assert [x for x in text.split("\n") if x.startswith("Part")] == [f"Part {i}" for i in range(5)] and text.count(SENTENCE) == 10


def test_tables_keep_their_rows():
    table = "<table><tr><th>Name</th><th>Value</th></tr><tr><td>alpha <b>one</b></td><td>1</td></tr><tr><td>beta<td>2</table>"
    assert main_text(page(f"<article><p>{SENTENCE}</p>{table}<p>{SENTENCE}</p></article>")).split("\n") == [SENTENCE, "Name | Value", "alpha one | 1", "beta | 2", SENTENCE]


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<html>") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<p>one<p>two<br>three</div></p>") == "one\ntwo\nthree"
    assert main_text(f"<div><p>{SENTENCE}<div hidden>secret</div><p>{SENTENCE} &amp; more &lt;") == f"{SENTENCE}\n{SENTENCE} & more <"
    deep = "<div>" * 5000 + SENTENCE + "</div>" * 5000
    assert main_text(deep) == SENTENCE
    assert main_text("<a href=x>" + "<li>" * 100 + "word") == ""  # nothing but a link


def test_short_pages_keep_all_their_lines():
    assert main_text(page("<nav>Home</nav><h1>Short</h1><p>Few words.</p>")) == "Short\nFew words."


def test_every_sentence_of_made_pages_is_found():
    rng = random.Random(7)
    for _ in range(60):
        lines = [f"{SENTENCE} {rng.random()}" for _ in range(rng.randrange(2, 9))]
        inner = "".join(rng.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>")).format(x) for x in lines)
        for _ in range(rng.randrange(4)):
            inner = f"<div>{inner}</div>"
        around = [f"<div class='{rng.choice(('sidebar', 'promo', 'comments', 'cookie-note'))}'>{SENTENCE}</div>", "<ul>" + "<li><a href='#'>link to elsewhere on this site</a></li>" * 9 + "</ul>"]
        rng.shuffle(around)
        assert main_text(page(around[0] + inner + around[1])).split("\n") == lines


class Rendering:
    def render(self, url):
        return None if "none" in url else page(f"<article><p>{SENTENCE}</p><p>{SENTENCE}</p><p>{SENTENCE}</p></article>")


def test_short_pages_get_a_second_attempt(spark):
    long = page(f"<p>{SENTENCE * 4}</p>")
    rows = [(1, "http://x.org/a", page("<p>loading</p>")), (2, "http://x.org/none", page("<p>short</p>")), (3, "http://x.org/b", long), (4, "http://x.org/c", None), (5, "http://x.org/a#top", page("<p>last one</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.source_uri: r.text for r in H.pages_to_documents(pages, renderer=Rendering()).collect()}
    whole = "\n".join([SENTENCE] * 3)
    assert got == {"http://x.org/a": whole, "http://x.org/none": "short", "http://x.org/b": SENTENCE * 4, "http://x.org/c": whole}
    plain = {r.source_uri: r.text for r in H.pages_to_documents(pages).collect()}
    assert plain == {"http://x.org/a": "last one", "http://x.org/none": "short", "http://x.org/b": SENTENCE * 4}


def test_odd_sections_do_not_stop_a_page():
    page = "<html><body><article><p>Some words stand here for a reader.</p><![bad]><p>More words follow.</p><![if !x]><p>The last.</p></article></body></html>"
    assert main_text(page).split("\n")[-1] == "The last." and "Some words" in main_text(page) and "bad" not in main_text(page)
