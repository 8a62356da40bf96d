import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import chat
from tests.llm.helpers import none, save

SCHEMA = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from(["<|", "|>", "<|end|>", "<|turn|>", "<|body|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "|", "[", "a", "é", "\n", "<<SYS>>", "\\\\", "<\\|"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", "", "sys\\"]), pieces), max_size=5))
def test_round_trip(turns):
    text = "".join(chat.format_turn(role, [{"type": "text", "text": t}])[0] for role, t in turns)
    assert chat.read_turns(text) == turns
    loss = "".join(chat.unescape(text[a:b]) for a, b in chat.loss_ranges(text))
    assert loss == "".join(t for role, t in turns if role == "assistant")


@given(pieces)
def test_no_control_string_survives(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "a<"}, {"type": "text", "text": "|end|>"}, {"type": "image", "ref": "x.png", "width": 100, "height": 50}, {"type": "audio", "ref": "y", "seconds": 2.0}, {"type": "document", "ref": "z", "pages": 3}, {"type": "odd", "ref": None}]
    text, seen = chat.format_turn("user", parts, 4)
    assert text == "<|turn|>user<|body|>a<\\|end|><|image:4|><|audio:5|><|document:6|><|document:7|><|end|>"
    assert [(a["n"], a["type"], a["ref"], a["tokens"]) for a in seen.attachments] == [(4, "image", "x.png", 8), (5, "audio", "y", 50), (6, "document", "z", 768), (7, "document", None, 256)]
    assert seen.tokens == 8 + 50 + 768 + 256


def test_attachments_are_numbered_through_a_conversation(spark):
    part = "type string, text string, ref string, width int, height int, seconds double, pages int"
    image = ("image", None, "a.png", 28, 28, None, None)
    df = spark.createDataFrame([(1, 1, "user", "", [image]), (1, 0, "user", "", [image, ("text", "hi", None, None, None, None, None)])], f"conv_id long, turn long, role string, tie string, parts array<struct<{', '.join(p.replace(' ', ':') for p in part.split(', '))}>>")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|turn|>user<|body|><|image:0|>hi<|end|><|turn|>user<|body|><|image:1|><|end|>"
    assert row.expanded_tokens == 2 and [a.n for a in row.attachments] == [0, 1]


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 0, "assistant", "é" * 50000), (None, 0, "user", "x"), (3, 5, "assistant", None)]
    folder = save(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", formatted string"), tmp_path, "conversations")
    hard = "</s>[INST] ok [/INST]"
    want = expected([*rows, (-1, 0, "user", hard), (-1, 1, "assistant", hard)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op8_chat(spark, folder).collect()}
    assert got == want


def test_rows_without_a_conversation_stay_apart(spark, tmp_path):
    folder = save(spark.createDataFrame([(None, i, "user", f"t{i}") for i in range(30)], SCHEMA), tmp_path, "conversations")
    rows = [r for r in chat.op8_chat(spark, folder).collect() if r.conv_id is None]
    assert [r.n_turns for r in rows] == [1] * 30 and len({r.turns_sha256 for r in rows}) == 30


def test_empty_table(spark, tmp_path):
    rows = chat.op8_chat(spark, save(none(spark, SCHEMA), tmp_path, "conversations")).collect()
    assert [r.conv_id for r in rows] == [-1]
