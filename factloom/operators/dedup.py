"""Order-aware removal of similar lines, one bucket of one document at a time.

A bucket holds what a document's retrieval returned for one entity: at most triples times k lines, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import renumber_bracket, renumber_prefix


class _Kept:
    """Unit vectors of the kept lines of one bucket, in order, and the slot of each; what has no direction is like nothing."""

    def __init__(self) -> None:
        self.n, self.unit, self.slot = 0, None, []

    def first_like(self, unit: np.ndarray, least: float) -> int:
        like = np.flatnonzero(self.unit[: self.n] @ unit >= least) if self.n else []
        return min(self.slot[i] for i in like) if len(like) else -1

    def put(self, unit: np.ndarray, slot: int) -> None:
        if slot in self.slot:  # a longer line takes it over
            self.unit[self.slot.index(slot)] = unit
            return
        if self.unit is None:
            self.unit = np.zeros((16, len(unit)))
        if self.n == len(self.unit):
            self.unit = np.concatenate([self.unit, np.zeros_like(self.unit)])
        self.unit[self.n] = unit
        self.slot.append(slot)
        self.n += 1


def _fold(df: DataFrame, keys: list[str], least: float, longest: bool) -> DataFrame:
    """Buckets one after the other in the order of the shuffle's sort; of a bucket only what is kept is held."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("seq", T.LongType()), T.StructField("line", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    rows = df.select(*keys, F.col("seq").cast("bigint").alias("seq"), F.col("line").cast("string").alias("line"), F.col("vec").cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, kept, slots, count = None, _Kept(), [], 0
        for batch in batches:
            who, out = list(zip(*(batch.column(k).to_pylist() for k in keys))), []
            vectors, lines, seqs = (batch.column(c) for c in ("vec", "line", "seq"))
            ends, flat, have = np.asarray(vectors.offsets), np.asarray(vectors.values, float), np.asarray(vectors.is_valid())
            for i in range(batch.num_rows):
                if who[i] != bucket:
                    out += [(*bucket, *x) for x in slots] if bucket else []
                    bucket, kept, slots, count = who[i], _Kept(), [], 0
                vec = flat[ends[i] : ends[i + 1]] if have[i] else flat[:0]
                length = np.linalg.norm(vec)
                at = kept.first_like(vec / length, least) if length > 0 else -1
                row = [seqs[i].as_py(), lines[i].as_py(), vec.tolist() if have[i] else None] if at < 0 or longest else None
                if at < 0:
                    out += [] if longest else [(*bucket, *row)]
                    at, count = count, count + 1
                    slots += [row] if longest else []
                elif longest and len(row[1] or "") > len(slots[at][1] or ""):
                    slots[at][1:] = row[1:]
                else:
                    continue
                if length > 0:
                    kept.put(vec / length, at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), batch.schema)], batch.schema.names)
            names, kind = batch.schema.names, batch.schema
        if slots:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((*bucket, *x) for x in slots)), kind)], names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "line").mapInArrow(run, schema)


def keep_first(df: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Of lines ``(<keys>, seq, line, vec)`` those not similar to a kept earlier one of the same keys, in order of ``seq``.

    A line whose vector is null or all zero is always kept and like no other. All vectors must be of one length.
    """
    return _fold(df, keys, least, False)


def keep_longest(df: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Lines put in slots of the same keys: a line goes to the first slot similar to it, and takes it over if it is longer; else it opens one. ``seq`` is that of the slot's first line."""
    return _fold(df, keys, least, True)


#: Rows of a bucket that one task folds; a bucket of more is parted by document.
FOLDED = 1 << 16


def fold_ids(placed: DataFrame, lines: DataFrame, least: float, longest: bool) -> DataFrame:
    """``(d, seq, line_id)`` kept of ``placed(d, seq, b, line_id)``, buckets ``(d, b)``: the same as ``keep_first`` or ``keep_longest``.

    ``lines(line_id, b, n_chars, vec)`` has each line once. A task gets whole buckets ``b`` of many documents and each of their
    lines once, so vectors don't cross the shuffle with every document; only a bucket of over FOLDED rows is parted, and its lines repeated.
    """
    large = placed.groupBy("b").agg(F.count("*").alias("_n")).where(F.col("_n") > FOLDED)
    large = large.join(lines.groupBy("b").agg(F.count("*").alias("_m")), "b")
    large = F.broadcast(large.select("b", F.ceil(F.col("_n") / F.greatest(F.lit(FOLDED), F.col("_m") * 4)).cast("int").alias("_s")))  # one of FOLDED rows at most
    parts = F.coalesce("_s", F.lit(1))
    rows = placed.join(large, "b", "left").select("b", F.pmod(F.xxhash64("d"), parts).cast("int").alias("z"), "d", "seq", "line_id", F.lit(None).cast("int").alias("n_chars"), F.lit(None).cast("array<float>").alias("vec"))
    each = lines.join(large, "b", "left").select("b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("z"), F.lit(None).cast("bigint").alias("d"), F.lit(None).cast("bigint").alias("seq"), "line_id", "n_chars", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known, bucket, kept, slots, count = None, {}, None, _Kept(), [], 0
        for batch in batches:
            out = []
            b, z, d, seq, line, chars = (batch.column(c).to_pylist() for c in ("b", "z", "d", "seq", "line_id", "n_chars"))
            vectors = batch.column("vec")
            ends, flat, have = np.asarray(vectors.offsets), np.asarray(vectors.values, float), np.asarray(vectors.is_valid())
            for i in range(batch.num_rows):
                if (b[i], z[i], d[i]) != bucket:
                    out += [(bucket[2], *x[:2]) for x in slots]
                    bucket, kept, slots, count = (b[i], z[i], d[i]), _Kept(), [], 0
                if d[i] is None:
                    if (b[i], z[i]) != group:
                        group, known = (b[i], z[i]), {}
                    vec = flat[ends[i] : ends[i + 1]] if have[i] else flat[:0]
                    length = np.linalg.norm(vec)
                    known[line[i]] = vec / length if length > 0 else None, chars[i]
                    continue
                unit, n = known[line[i]]
                at = kept.first_like(unit, least) if unit is not None else -1
                if at < 0:
                    out += [] if longest else [(d[i], seq[i], line[i])]
                    at, count = count, count + 1
                    slots += [[seq[i], line[i], n]] if longest else []
                elif longest and n > slots[at][2]:
                    slots[at][1:] = line[i], n
                else:
                    continue
                if unit is not None:
                    kept.put(unit, at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["d", "seq", "line_id"])
        if slots:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((bucket[2], *x[:2]) for x in slots))], ["d", "seq", "line_id"])

    return rows.unionByName(each).repartition("b", "z").sortWithinPartitions("b", "z", "d", "seq").mapInArrow(run, "d bigint, seq bigint, line_id bigint")


def renumber(df: DataFrame, doc: str, order: list[str], style: str = "bracket") -> DataFrame:
    """Adds ``n`` (from 1 in each document) and ``text``, the line with its new number."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    text = (renumber_bracket if style == "bracket" else renumber_prefix)("line", F.col("n"))
    return df.withColumn("n", n).withColumn("text", text)
