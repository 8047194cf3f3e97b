"""Language models and sentence encoders behind small protocols, so that every pipeline can be replayed.

A provider turns a table into a table: answers come from a replay table, vectors from a table or from a function
of the text. What calls a real service would implement the same protocol, retry within limits and record its answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Answers(Protocol):
    def answer(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, round_no, raw)`` for documents ``(doc_id, text)``."""


class Encoder(Protocol):
    def encode(self, texts: DataFrame, text: str, to: str = "vec") -> DataFrame:
        """``texts`` with a vector column."""


class ReplayAnswers:
    """Recorded answers ``(doc_id, round_no, raw)``."""

    def __init__(self, recorded: DataFrame) -> None:
        self.recorded = recorded

    def answer(self, docs: DataFrame) -> DataFrame:
        return self.recorded.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "round_no", "raw")


class HashingEncoder:
    """Unit vectors of hashed character pairs: deterministic, without a model. Texts of fewer than two characters get a null vector."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def encode(self, texts: DataFrame, text: str, to: str = "vec") -> DataFrame:
        return texts.withColumn(to, F.arrow_udf(lambda t: _hashed_pairs(t, self.size), "array<float>")(F.col(text)))


def _hashed_pairs(texts: pa.Array, size: int) -> pa.Array:
    """Per text, how often each of ``size`` buckets gets a pair of neighbouring characters, scaled to length 1."""
    held = [t or "" for t in texts.to_pylist()]
    length = np.array([len(t) for t in held], np.int64)
    code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(held)), length)
    inside = row[1:] == row[:-1]
    mixed = ((code[:-1] << np.uint64(21) | code[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(size)
    count = np.bincount(row[1:][inside] * size + mixed[inside].astype(np.int64), minlength=len(held) * size).reshape(len(held), size).astype(float)
    norm = np.linalg.norm(count, axis=1, keepdims=True)
    unit = np.divide(count, norm, out=count, where=norm > 0).astype(np.float32)
    ends = np.arange(len(held) + 1, dtype=np.int32) * size
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()), mask=pa.array(norm[:, 0] == 0))


class TableEncoder:
    """Vectors computed before: ``(text, vec)``, joined by text."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors

    def encode(self, texts: DataFrame, text: str, to: str = "vec") -> DataFrame:
        known = self.vectors.select(F.col("text").alias("_t"), F.col("vec").alias(to)).dropDuplicates(["_t"])
        return texts.join(known, texts[text] == known["_t"], "left").drop("_t")


def with_retry(call: Callable, attempts: int = 5, first: float = 5.0, most: float = 60.0, sleep: Callable = time.sleep) -> Callable:
    """``call`` repeated after errors, waiting twice as long each time up to ``most`` seconds; the last error is raised."""

    def run(*args, **kwargs):
        wait = first
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:
                if n + 1 == attempts:
                    raise
                sleep(wait)
                wait = min(most, 2 * wait)

    return run
