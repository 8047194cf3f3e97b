"""Exact vector search, pooling and chunking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import written

#: Numbers in the vectors of one block of queries, which every task holds: 32 MB; more queries are taken block by block.
QUERY_NUMBERS = 1 << 22
#: Queries and rows of one tile of similarities, and pairs that may wait before they are cut to the best of each query.
TILE, WAITING = 1024, 1 << 20


def _units(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(pc.list_flatten(vectors), dtype=float).reshape(len(vectors), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


class _Best:
    """The ``k`` best rows of each query so far, by cosine and then the larger id; ``floor`` is what a further one must reach."""

    def __init__(self, n: int, k: int, least: float | None) -> None:
        self.k, self.floor = k, np.full(n, -2.0 if least is None else least)
        self.kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, row: np.ndarray, sim: np.ndarray) -> None:
        good = sim >= self.floor[x]
        self.waiting.append((x[good], row[good], sim[good]))
        if sum(len(w[0]) for w in self.waiting) > WAITING:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, row, sim = (np.concatenate(c) for c in zip(self.kept, *self.waiting))
        order = np.lexsort((-row, -sim, x))
        x, row, sim = x[order], row[order], sim[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        last = place == self.k - 1
        self.floor[x[last]] = np.maximum(self.floor[x[last]], sim[last])
        self.kept, self.waiting = (x[place < self.k], row[place < self.k], sim[place < self.k]), []
        return self.kept


def _scan(held, k: int, least: float | None):
    """Arrow function over rows: the ``k`` best of a task's rows for each of the held queries."""

    def run(batches):
        q_id, unit = held.value
        flat, slack = unit.astype(np.float32), unit.shape[1] * 2.0**-23 + 1e-6  # sifted in single precision, compared in double
        best = _Best(len(q_id), k, least)
        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                part = batch.slice(a, TILE)
                rows, row = _units(part.column("vec")), np.asarray(part.column("r_id"))
                few = rows.astype(np.float32)
                for b in range(0, len(unit), TILE):
                    near = flat[b : b + TILE] @ few.T
                    low = best.floor[b : b + TILE]
                    if len(row) > k and (low < -1.5).any():  # nothing found yet: the tile's own k-th best is a bound
                        low = np.maximum(low, np.partition(near, len(row) - k, axis=1)[:, len(row) - k] - slack)
                    x, y = np.nonzero(near >= (low[:, None] - slack).astype(np.float32))
                    best.add(x + b, row[y], np.einsum("ij,ij->i", unit[x + b], rows[y]))
        x, row, sim = best.cut()
        for a in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(q_id[x[a : a + (1 << 16)]]), pa.array(row[a : a + (1 << 16)]), pa.array(sim[a : a + (1 << 16)])], ["q_id", "r_id", "sim"])

    return run


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 100, least: float | None = None) -> DataFrame:
    """For each of ``queries(q_id, vec)`` its ``k`` most similar of ``rows(r_id, vec)``: ``(q_id, r_id, sim, rank)``.

    Exact cosine in double precision; ties go to the larger ``r_id``. ``least`` is applied before the rank, which
    gives the same result as after it. Rows stay where they are: each task holds one block of queries, of counted
    size, and returns at most ``k`` rows a query, which alone cross the shuffle; beyond QUERY_NUMBERS the rows are passed
    once for each block. Null, empty and all-zero vectors take no part; all vectors must be of one length. Ids are
    64-bit integers, those of queries unique. A query that is also a row finds itself.
    """
    spark = queries.sparkSession
    fresh = lambda df, i: df.where(F.exists("vec", lambda x: x != 0)).select(F.col(i).cast("bigint").alias(i), "vec")
    q, r = written(fresh(queries, "q_id"), "queries"), fresh(rows, "r_id")
    n, size = q.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).head()
    blocks = max(1, -(-n * size // QUERY_NUMBERS))
    found = None
    for b in range(blocks):
        mine = q.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((np.asarray(mine.column("q_id")), _units(mine.column("vec").combine_chunks()) if mine.num_rows else np.zeros((0, 1))))
        part = r.mapInArrow(_scan(held, k, least), "q_id bigint, r_id bigint, sim double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("q_id").orderBy(F.col("sim").desc(), F.col("r_id").desc())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean of the vectors of each key: ``(<key>, vec array<double>)``. Null vectors are left out.

    Sums are made per task before the shuffle; the vectors of a key must be of one length.
    """
    have = df.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return have.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(key, vector_to_array("_m").alias("vec"))


def token_pieces(text: Column | str) -> Column:
    """Tokens that together are the whole text: Han characters one by one, other words whole, white space with what follows it."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"(?U)\s*\p{IsHan}|\s*[^\s\p{IsHan}]+|\s+$"), F.lit(0))


def token_chunks(df: DataFrame, key: str, text: str, window: int = 510, stride: int = 256, tokens: Callable[[Column], Column] = token_pieces) -> DataFrame:
    """Overlapping windows of ``window`` tokens, a new one every ``stride``, until one reaches the end: ``(<key>, chunk_no, n_tokens, chunk)``.

    ``tokens`` makes the list of tokens whose concatenation is the text (that of an encoder's own tokenizer, where it
    has one). A text within the window is one chunk, as it stands; null and empty texts have none.
    """
    split = df.select(F.col(key).alias(key), F.col(text).alias("_text"), tokens(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_t") - window) / F.lit(float(stride)))).cast("int")
    each = split.select(key, "_text", "_t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.slice("_t", F.col("chunk_no") * stride + 1, F.lit(window))
    return each.select(key, "chunk_no", F.size(part).alias("n_tokens"), F.when(F.size("_t") <= window, F.col("_text")).otherwise(F.array_join(part, "")).alias("chunk"))


def sliding_chunks(df: DataFrame, key: str, text: str, window: int = 510, stride: int = 256) -> DataFrame:
    """Overlapping pieces of ``window`` characters, a new one every ``stride``, until one reaches the end.

    ``(<key>, chunk_no, start, chunk)``; a text within the window is one piece, null and empty texts have none.
    """
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(float(stride)))).cast("int") * stride
    starts = df.where(n > 0).select(key, text, F.posexplode(F.sequence(F.lit(0), last, F.lit(stride))).alias("chunk_no", "start"))
    return starts.select(key, "chunk_no", "start", F.substr(text, F.col("start") + 1, F.lit(window)).alias("chunk"))
