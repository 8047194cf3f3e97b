"""Oversized texts cut into pieces at natural boundaries by packing a structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.json_arrow import nodes, slices

#: Boundaries by rank: 1 at a block tag within a line, 2 after a sentence end, 3 after a line break, 4 before a list item, 5 after a blank line, 6 before a heading.
TAG, SENTENCE, LINE, ITEM, BLANK, HEADING = range(1, 7)
_LINES = r"\n\r\v\f\x1c-\x1e\x85\u2028\u2029"
_BLOCK = r"(?:h[1-6]|p|li|ul|ol|tr|table|div|section)\b"
_BREAK = re.compile(rf"\r\n|[{_LINES}]|[。！？!?]+|\.(?=\s)|(?=<{_BLOCK})|</{_BLOCK}[^<>]*>")
_LINE = re.compile(rf"[{_LINES}]")
_HEADING = re.compile(r"#{1,6}\s|<h[1-6]\b|[一二三四五六七八九十]{1,3}、|第[一二三四五六七八九十百\d]+[章節條条]")
_ITEM = re.compile(r"[-*+•]\s|\d{1,3}[.)、]\s?|<(?:li|p|tr|div)\b")


def boundaries(text: str) -> tuple[list[tuple[int, int]], int]:
    """Places where the text may be cut, as ``(place, rank)`` in order, and the length of its longest stretch without a sentence end or line break."""
    cuts: list[tuple[int, int]] = []
    longest, last = 0, 0
    for m in _BREAK.finditer(text):
        at, rank = m.end(), TAG
        if m[0][:1] not in ("", "<"):
            longest = max(longest, m.start() - last)
            last, rank = at, SENTENCE
            if _LINE.match(m[0]):
                blank = cuts and cuts[-1][0] == m.start() and cuts[-1][1] >= LINE
                rank = BLANK if blank else HEADING if _HEADING.match(text, at) else ITEM if _ITEM.match(text, at) else LINE
        if 0 < at < len(text) and not (rank == TAG and cuts and cuts[-1][0] == at):
            cuts.append((at, rank))
    return cuts, max(longest, len(text) - last)


def pack(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, bool]], bool]:
    """New stretches ``(start, end, cut at a boundary)`` that cover the text, and whether it has an unbroken stretch over ``limit``.

    A node of the tree is a stretch between two boundaries of some rank; its children lie between the
    boundaries of the next lower rank in it. From the bottom up, neighbouring children that are whole are merged
    while they fit; a node that does not fit is opened, and what it leaves is not merged with its own siblings. What
    has no boundary left is cut by length. The first piece holds ``limit`` characters, each further one leaves room
    for ``overlap``.
    """
    cuts, longest = boundaries(text)

    def room(start: int) -> int:
        return limit - (overlap if start else 0)

    def pieces(a: int, b: int, i: int, j: int, rank: int) -> list[tuple[int, int, bool]]:
        if b - a <= room(a):
            return [(a, b, True)]
        rank = max((r for _, r in cuts[i:j] if r <= rank), default=0)
        if not rank:
            ends = [a + room(a)]
            while ends[-1] < b:
                ends.append(ends[-1] + room(ends[-1]))
            return [(x, min(y, b), y >= b) for x, y in zip([a, *ends], ends)]
        out: list[tuple[int, int, bool]] = []
        start, first, whole = a, i, False  # whole: the last of ``out`` is made of unopened children
        for n in [*(n for n in range(i, j) if cuts[n][1] >= rank), j]:
            end = cuts[n][0] if n < j else b
            got = pieces(start, end, first, n, rank - 1)
            if len(got) == 1 and whole and end - out[-1][0] <= room(out[-1][0]):
                out[-1] = (out[-1][0], end, True)
            else:
                out += got
                whole = len(got) == 1
            start, first = end, n + 1
        return out

    return pieces(0, len(text), 0, len(cuts), HEADING) if text else [], longest > limit


def split_items(items: DataFrame, keys: list[str], text: str, limit: int = 600, overlap: int = 60) -> DataFrame:
    """Pieces of every item over ``limit`` code points: ``(<keys>, piece_no, start, piece, natural, hard)``.

    ``piece`` is at most ``limit`` long and repeats the last ``overlap`` characters of the one before, ``start``
    is the place of its first new character; leaving out the repeats, the pieces give the whole text. ``natural``
    tells whether the piece ends at a boundary, ``hard`` whether the item has a stretch of over ``limit``
    characters without one. Nulls and items within the limit give no rows; repeated rows are cut again; no
    shuffle, one record at a time, however long.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    added = [T.StructField("piece_no", T.LongType()), T.StructField("start", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("natural", T.BooleanType()), T.StructField("hard", T.BooleanType())]
    schema = T.StructType([items.schema[k] for k in keys] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows, columns = [], [[] for _ in added]
                for r, t in enumerate(part.column(text).to_pylist()):
                    pieces, hard = pack(t, limit, overlap)
                    for n, (a, b, natural) in enumerate(pieces):
                        rows.append(r)
                        for c, v in zip(columns, (n, a, t[max(0, a - overlap) : b], natural, hard)):
                            c.append(v)
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(index) for k in keys), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())))], schema.names)

    return items.where(F.length(text) > limit).select(*dict.fromkeys([*keys, text])).mapInArrow(run, schema)


def text_members(df: DataFrame, rec: str, text: str, least: int) -> DataFrame:
    """Top-level text values over ``least`` bytes of complete JSON objects: ``(<rec>, field, value)``."""
    schema = T.StructType([df.schema[rec], T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = nodes(part.column(text))
                own = ((x.depth == 1) & x.is_string() & (x.end - x.start > least)).nonzero()[0]
                yield pa.RecordBatch.from_arrays([part.column(rec).take(pa.array(x.row[own])), x.key.take(pa.array(own)).cast(pa.string()), x.text(own).cast(pa.string())], schema.names)

    return df.where(F.length(text) > least).select(rec, text).mapInArrow(run, schema)
