"""Splitting oversized texts at natural boundaries.

A hierarchy of separators (section, paragraph, line, sentence, word, character) cuts a text into
units that fit; units are packed greedily up to the limit, and every piece but the first begins
with the last `overlap` characters of the piece before it. Positions count Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")
#: Fixed patterns: the end of each match ends a unit, so separators stay with the unit before them.
SEPARATORS = (
    re.compile(r"\n(?=#{1,6} )|\n[ \t]*\n[ \t]*\n\s*|\f"),
    re.compile(r"\r?\n[ \t]*\r?\n\s*"),
    re.compile(r"\r?\n|\r"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*[ \t\r\n]+|[。！？]+[」』）]*"),
    re.compile(r"[ \t\r\n]+"),
)
SCHEMA = "seq int, start int, stop int, cut string, piece string, unbroken_from int"


def units(text: str, start: int, stop: int, room: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """(end, level of the cut) of consecutive units of text[start:stop], none longer than `room`.

    A part that fits is one unit; one that doesn't is cut by the next separator of the hierarchy."""
    stack = [(start, stop, level, "end")]
    while stack:
        a, b, lv, by = stack.pop()
        if b - a <= room:
            yield b, by
        elif lv >= len(SEPARATORS):
            for e in range(a + room, b, room):
                yield e, LEVELS[-1]
            yield b, by
        else:
            ends = [m.end() for m in SEPARATORS[lv].finditer(text, a, b) if a < m.end() < b]
            parts, at = [], a
            for e in ends:
                parts.append((at, e, lv + 1, LEVELS[lv]))
                at = e
            parts.append((at, b, lv + 1, by))
            stack.extend(reversed(parts))


def first_unbroken(text: str, limit: int) -> int:
    """From which position on, counted from 1, the word level finds more than `limit` characters without white space; 0 if nowhere."""
    at = 0
    for m in SEPARATORS[4].finditer(text):
        if m.start() - at > limit:
            return at + 1
        at = m.end()
    return at + 1 if len(text) - at > limit else 0


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, stop, cut) of the pieces: at most `limit` characters each, start = previous stop - overlap.

    `cut` names the boundary at which the piece ends, "end" for the last. A text within the limit,
    the empty one included, is one piece."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    out: list[tuple[int, int, str]] = []
    start, stop, cut = 0, 0, ""
    for end, by in units(text, 0, len(text), limit - overlap):
        if end - start > limit:
            out.append((start, stop, cut))
            start = stop - min(overlap, stop - start)
        stop, cut = end, by
    return [*out, (start, stop, cut)]


def rejoin(parts: list[tuple[int, str]]) -> str:
    """The text again from (start, piece) in any order."""
    out, at = [], 0
    for start, piece in sorted(parts):
        out.append(piece[at - start :])
        at = start + len(piece)
    return "".join(out)


def split_oversized(records: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """The pieces of every record whose text is longer than `limit`.

    Gives (key, seq from 0, start and stop from 0, cut, piece, unbroken_from); unbroken_from belongs to
    the whole record: where, counted from 1, its first stretch of more than `limit` characters without
    white space begins, 0 if there is none. Null and short texts give no rows, repeated records repeat
    their pieces, null keys stay null, other columns are not used."""
    long = records.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.length("text") > limit)
    schema = f"key {long.schema['key'].dataType.simpleString()}, {SCHEMA}"

    def cut(batches):
        import pyarrow as pa

        names = ("key", "seq", "start", "stop", "cut", "piece", "unbroken_from")
        for t in batches:
            for i in range(t.num_rows):  # a text at a time: the pieces of a batch may be far larger than it
                body = t.column("text")[i].as_py()
                got, free = pieces(body, limit, overlap), first_unbroken(body, limit)
                n = len(got)
                yield pa.RecordBatch.from_arrays(
                    [t.column("key").take(pa.array([i] * n)), pa.array(range(n), pa.int32()), pa.array([p[0] for p in got], pa.int32()), pa.array([p[1] for p in got], pa.int32()), pa.array([p[2] for p in got]), pa.array([body[p[0] : p[1]] for p in got]), pa.array([free] * n, pa.int32())],
                    names=names,
                )

    return long.mapInArrow(cut, schema).withColumnRenamed("key", key)
