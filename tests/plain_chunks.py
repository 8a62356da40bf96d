"""Structured chunkers over plain strings, against which the expressions are tested."""

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from docloom.functions.chunking import OVERLAP, SECTION_SIZE, SIZE, chunk_text

_HEADING = re.compile(r"^(#{1,6}) ", re.M)
_SECTION = re.compile(r"^#{1,2} ", re.M)
_SUBSECTION = re.compile(r"^### ", re.M)
_TABLE_LINE = re.compile(r"^\|.*\|")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")


def heading_level(section: str) -> int | None:
    found = _HEADING.match(section)
    return len(found[1]) if found else None


def pages_of(start: int, end: int, offsets: list[int], pages: dict[int, int]) -> list[int]:
    """Pages that characters start to end (exclusive) lie on; before the first offset counts as the first page."""
    at = max(0, bisect_right(offsets, start) - 1)
    return [pages[o] for i, o in enumerate(offsets[at:], at) if o < end and (i + 1 == len(offsets) or offsets[i + 1] > start)]


def short_image_refs(text: str) -> str:
    """Image references with the file's base name only."""
    return _IMAGE.sub(lambda m: f"![{m[1]}]({m[2].rsplit('/', 1)[-1]})", text)


@dataclass
class _Pages:
    """Chunks with the pages their characters lie on."""

    pages: dict[int, int]

    def __post_init__(self) -> None:
        self.offsets, self.out = sorted(self.pages), []

    def at(self, start: int, length: int) -> list[int]:
        return pages_of(start, start + length, self.offsets, self.pages) if self.pages else []

    def add(self, text: str, pages: list[int]) -> None:
        if text.strip():
            self.out.append((short_image_refs(text.strip()), pages))


def _cut(text: str, pattern: re.Pattern) -> list[tuple[str, int]]:
    """(piece, offset) of a text cut before each match; what stands before the first is a piece if not blank."""
    marks = [m.start() for m in pattern.finditer(text)]
    if not marks:
        return []
    edges = ([0] if text[: marks[0]].strip() else []) + marks
    return [(text[a:b], a) for a, b in zip(edges, [*edges[1:], len(text)])]


def _runs(lines: list[str]) -> Iterator[tuple[bool, str]]:
    """(is table, text) of runs of table lines and of other lines."""
    held: list[str] = []
    for i, line in enumerate(lines):
        held.append(line)
        table = bool(_TABLE_LINE.match(line))
        if i + 1 == len(lines) or bool(_TABLE_LINE.match(lines[i + 1])) != table:
            yield table, "\n".join(held)
            held = []


@dataclass
class _Section:
    text: str
    at: int

    def __post_init__(self) -> None:
        self.level = heading_level(self.text)


def _joined(sections: list[_Section], size: int) -> list[list[_Section]]:
    """Sections in groups: a small one takes the deeper ones after it, as long as all fit."""
    groups: list[list[_Section]] = []
    for section in sections:
        group = groups[-1] if groups else None
        deeper = group and None not in (group[0].level, section.level) and section.level > group[0].level
        if deeper and len(group[0].text) < size // 4 and sum(len(s.text) for s in group) + len(section.text) <= size:
            group.append(section)
        else:
            groups.append([section])
    return groups


def _pieces(section: _Section, size: int, overlap: int) -> list[str]:
    """A large section cut into windows around its tables; the heading goes with the first."""
    head, *body = section.text.split("\n") if section.level is not None else ("", *section.text.split("\n"))
    pieces = [piece for table, run in _runs(body) for piece in ([run] if table else chunk_text(run, size, overlap))]
    return [f"{head}\n{pieces[0]}", *pieces[1:]] if head and pieces else pieces


def chunk_markdown(text: str, size: int = SIZE, overlap: int = OVERLAP, pages: dict[int, int] | None = None) -> list[tuple[str, list[int]]]:
    """(chunk, pages) of markdown: sections, small ones joined with deeper ones after them, large ones cut around tables."""
    out = _Pages(pages or {})
    sections = [_Section(*cut) for cut in _cut(text, _HEADING) or [(text, 0)]] if text.strip() else []
    for group in _joined(sections, size):
        whole = "".join(s.text for s in group)
        for piece in _pieces(group[0], size, overlap) if len(whole) > size else [whole]:
            out.add(piece, out.at(group[0].at, len(whole)))
    return out.out


def _paragraphs(text: str, most: int, at: int, out: _Pages) -> None:
    """Packs paragraphs greedily up to ``most`` characters."""
    held, held_at, cursor = "", at, at
    for paragraph in text.split("\n\n"):
        if paragraph.strip():
            if held and len(held) + 2 + len(paragraph) > most:
                out.add(held, out.at(held_at, len(held)))
                held = ""
            held_at = held_at if held else cursor
            held = f"{held}\n\n{paragraph}" if held else paragraph
        cursor += len(paragraph) + 2
    out.add(held, out.at(held_at, len(held)))


def chunk_sections(text: str, most: int = SECTION_SIZE, pages: dict[int, int] | None = None) -> list[tuple[str, list[int]]]:
    """(chunk, pages) by first and second level sections; large ones by third level, then by paragraphs."""
    out = _Pages(pages or {})

    def bare(piece: str) -> bool:
        """A heading without a body."""
        first, _, rest = piece.strip().partition("\n")
        return bool(_SECTION.match(first)) and not rest.strip()

    def emit(piece: str, at: int) -> bool:
        if len(piece.strip()) > most:
            return False
        if not bare(piece):
            out.add(piece, out.at(at, len(piece)))
        return True

    sections = _cut(text, _SECTION)
    if not sections and not emit(text, 0):
        _paragraphs(text, most, 0, out)
    for section, at in sections:
        if emit(section, at):
            continue
        parts = _cut(section, _SUBSECTION)
        for part, more in parts if len(parts) > 1 else [(section, 0)]:
            if not (len(parts) > 1 and emit(part, at + more)):
                _paragraphs(part, most, at + more, out)
    return out.out
