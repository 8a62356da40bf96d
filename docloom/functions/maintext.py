"""Main text of web pages: a tree of blocks, scored by text, links and nesting.

A page is parsed into blocks, each with its lines of running text and how much of them stands
in links. Blocks that are hidden or hold no content by their tag, role or name (navigation,
footers, advertisements, forms, comments) are left out with all they hold. A paragraph gives
its score to the block around it, half of it to the next one and a third to the one after; the
block with the best score is the content. Blocks beside it join it if they score a fifth of it. Of the content
all lines are kept that are not mostly links; the cells of a table's row stay on one line.
A page without a paragraph of any length keeps all its lines that are not left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

SPACE = " \t\n\r\f\v"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas button select textarea dialog".split())
APART = frozenset("nav footer aside form menu".split())
#: Words of a class or an id that say a block is no content, and roles that say so.
NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments cookie cookies disqus footer legal menu meta modal nav navbar "
    "navigation newsletter pager pagination popup promo promoted recommended related share sharing sidebar skip social sponsor sponsored subscribe tags toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar toolbar alert".split())
#: Blocks that a new one of their kind ends.
SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Least length of a line that counts as a paragraph, share of links of a line that is none, share of the best score for a neighbour.
PARAGRAPH, LINKED, BESIDE = 25, 0.5, 0.2
#: Blocks inside each other beyond this many are lines of the last one.
DEEPEST = 200


# What begins like a marked section but is no CDATA ends at the next ">", as a comment does.
_ODD_SECTION = re.compile(r"<!\[(?!CDATA\[)[^>]*>?")


def readable(html: str) -> str:
    """HTML without the marked sections that the parser refuses as a whole page."""
    return _ODD_SECTION.sub("", html)


@dataclass
class Line:
    text: str
    links: int

    @property
    def density(self) -> float:
        return min(1.0, self.links / len(self.text)) if self.text else 0.0

    def score(self) -> float:
        """Longer lines with more clauses and fewer links count more."""
        return (1 + min(len(self.text) / 100, 3) + min(self.text.count(","), 3)) * (1 - self.density)


@dataclass
class Block:
    tag: str
    parent: Block | None = None
    apart: bool = False
    parts: list[Block | Line] = field(default_factory=list)
    own: float = 0.0
    whole: float = 0.0

    def blocks(self) -> list[Block]:
        return [x for x in self.parts if isinstance(x, Block)]


def _apart(tag: str, attrs: dict[str, str | None]) -> bool:
    words = re.split(r"[^a-z0-9]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I)
    return tag in HIDDEN or tag in APART or bool(hidden) or (attrs.get("role") or "").lower() in ROLES or (tag not in ("html", "body", "main", "article") and not NAMES.isdisjoint(words))


class _Tree(HTMLParser):
    """Blocks of a page; what a page leaves open is closed by what comes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Block("html")
        self.open = [self.root]
        self.text, self.links, self.inside = [], 0, 0  # running text, its characters in links, open links

    def flush(self) -> None:
        """Ends the line that is being read."""
        text = re.sub(f"[{SPACE}]+", " ", "".join(self.text)).strip(SPACE)
        if text:
            self.open[-1].parts.append(Line(text, self.links))
        self.text, self.links = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.inside += 1
        if tag in ("br", "hr"):
            self.flush()
        if tag in VOID or tag in INLINE and not _apart(tag, dict(attrs)):
            return
        self.flush()
        if tag in ("html", "body") and len(self.open) <= 2:
            return
        ends = SAME.get(tag, {"p"} if tag not in INLINE and tag not in HIDDEN else set())
        limit = {"ul", "ol", "dl", "table"} if tag != "p" else {"li", "td", "th", "dd"}
        cut = len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in limit:
                break
            if self.open[i].tag in ends:
                cut = i
        del self.open[cut:]
        if len(self.open) >= DEEPEST:
            return
        block = Block(tag, self.open[-1], self.open[-1].apart or _apart(tag, dict(attrs)))
        self.open[-1].parts.append(block)
        self.open.append(block)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.inside = max(0, self.inside - 1)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.flush()
                self.inside = 0 if tag not in INLINE else self.inside
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.inside:
            self.links += len(data.strip(SPACE))

    def tree(self, html: str) -> Block:
        self.feed(readable(html))
        self.close()
        self.flush()
        return self.root


def _walk(block: Block) -> list[Block]:
    """All blocks below one that are content or may be, parents first."""
    out, todo = [], [block]
    while todo:
        x = todo.pop()
        if not x.apart:
            out.append(x)
            todo.extend(reversed(x.blocks()))
    return out


def _scored(root: Block) -> list[Block]:
    """Blocks with the scores that their paragraphs give them."""
    blocks = _walk(root)
    for block in blocks:
        if block.tag in HEADINGS:
            continue
        for line in block.parts:
            if isinstance(line, Line) and len(line.text) >= PARAGRAPH:
                at, gift = block if block.tag not in ("p", "pre", "blockquote", "td", "th", "li", "dd") else block.parent, line.score()
                for share in (1, 2, 3):
                    if at is None:
                        break
                    at.own += gift / share
                    at = at.parent
    for block in reversed(blocks):
        block.whole += block.own
        if block.parent is not None:
            block.parent.whole = max(block.parent.whole, block.whole)
    return blocks


def _lines(block: Block, every: bool = False) -> list[str]:
    """Kept lines of a block in order; the cells of a row are one line."""
    if block.apart:
        return []
    if block.tag == "tr":
        cells = [" ".join(_lines(x, True)) if isinstance(x, Block) else x.text for x in block.parts]
        return [" | ".join(c for c in cells if c)] if any(cells) else []
    out = []
    for x in block.parts:
        if isinstance(x, Block):
            out += _lines(x, every or x.tag in HEADINGS)
        elif every or x.density < LINKED:
            out.append(x.text)
    return out


def main_text(html: str | None) -> str:
    """The lines of a page's content; empty without any."""
    root = _Tree().tree(html or "")
    blocks = _scored(root)
    best = max(blocks, key=lambda b: b.own, default=root)
    if best.own <= 0:
        return "\n".join(_lines(root))
    beside = best.parent.blocks() if best.parent is not None else [best]
    kept = [b for b in beside if b is best or not b.apart and b.whole >= BESIDE * best.own]
    return "\n".join(line for b in kept for line in _lines(b))
