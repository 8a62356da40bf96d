"""Chat formatting with typed content parts.

A visitor walks the parts of each turn in order. Text parts are escaped; image, audio and
document parts become placeholders, are recorded as attachment references, and count the
tokens they will expand to. Turns are joined by a template:

    <|turn|>role<|body|>content<|end|>

and attachments stand in the content as <|image:n|>, <|audio:n|> or <|document:n|>, where n
counts attachments of the conversation. Control strings inside a text or role are escaped by
a backslash after their first character, and backslashes are doubled, so reading undoes
escaping exactly. The loss mask covers the content of assistant turns.

Cases: null texts are empty; a null role is empty; turns are ordered by turn (null first),
ties by role and text; each row without a conversation id is a conversation of its own; unknown part types count
as documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
# Control strings of common templates; none may appear unescaped in a text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join([re.escape("\\"), *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)

#: Tokens an attachment expands to.
IMAGE_PATCH, AUDIO_TOKENS_PER_SECOND, PAGE_TOKENS = 28, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    """``text`` without control strings."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flattened:
    """What a visitor gathers from the parts of a turn; placeholders are numbered from ``first``.

    Texts side by side are escaped as one, as a control string could span them.
    """

    first: int = 0
    text: str = ""
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.text += part.get("text") or ""

    def visit_image(self, part: dict) -> None:
        wide, high = part.get("width") or IMAGE_PATCH, part.get("height") or IMAGE_PATCH
        self._hold("image", part, -(-wide // IMAGE_PATCH) * -(-high // IMAGE_PATCH))

    def visit_audio(self, part: dict) -> None:
        self._hold("audio", part, max(1, round((part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._hold("document", part, (part.get("pages") or 1) * PAGE_TOKENS)

    def close(self) -> None:
        self.out.append(escape(self.text))
        self.text = ""

    def _hold(self, kind: str, part: dict, tokens: int) -> None:
        self.close()
        n = self.first + len(self.attachments)
        self.out.append(f"<|{kind}:{n}|>")
        self.attachments.append({"n": n, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens


def flatten(parts: list[dict], first: int = 0) -> Flattened:
    seen = Flattened(first)
    for part in parts:
        seen.visit(part)
    seen.close()
    return seen


def format_turn(role: str, parts: list[dict], first: int = 0) -> tuple[str, Flattened]:
    """A turn as the template has it, and what its parts gave."""
    seen = flatten(parts, first)
    return f"{TURN}{escape(role)}{BODY}{''.join(seen.out)}{END}", seen


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, unescaped; placeholders stand as they are."""
    turns = []
    for turn in formatted.split(TURN)[1:]:
        role, _, body = turn.removesuffix(END).partition(BODY)
        turns.append((unescape(role), unescape(body)))
    return turns


def loss_ranges(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Code point ranges of the formatted text under the loss mask."""
    head, out, at = TURN + escape(role) + BODY, [], 0
    while (at := formatted.find(TURN, at)) >= 0:
        stop = formatted.find(END, at)
        if formatted.startswith(head, at):
            out.append((at + len(head), stop))
        at = stop
    return out


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> a row for each conversation with formatted text, attachments and tokens."""
    result = "formatted string, attachments array<struct<n:int,type:string,ref:string,tokens:int>>, expanded_tokens long, n_turns long"
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    ordered = turns.withColumn("alone", alone).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "tie", "parts"))).alias("turns"))

    @F.pandas_udf(result)
    def formatted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conversation in batch:
                text, attached, tokens = [], [], 0
                for t in conversation:
                    one, seen = format_turn(t["role"], [dict(p) for p in t["parts"]], len(attached))
                    text.append(one)
                    attached += seen.attachments
                    tokens += seen.tokens
                rows.append(("".join(text), attached, tokens, len(conversation)))
            yield pd.DataFrame(rows, columns=["formatted", "attachments", "expanded_tokens", "n_turns"])

    return ordered.select("conv_id", formatted("turns").alias("f")).select("conv_id", "f.*")


def text_parts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tie, parts) of plain conversations: one text part for each row."""
    text = F.coalesce("text", F.lit(""))
    part = F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return conversations.select("conv_id", "turn", "role", text.alias("tie"), F.array(part).alias("parts"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text holds."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                turns = read_turns(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[a:b]) for a, b in loss_ranges(text))
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", digests("formatted").alias("d")).select("conv_id", "d.*")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and one that says control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    return read_back(format_conversations(text_parts(rows.unionByName(more))))


OP8_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
escaped AS (SELECT *,
  regexp_replace(replace(role, '\\', '\\\\'), '(<\\||<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>)', '\\1@', 'g') AS r,
  regexp_replace(replace(text, '\\', '\\\\'), '(<\\||<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>)', '\\1@', 'g') AS t FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + 23)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id, alone
"""
