"""Triples of answers: merging rounds, and the shapes they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _full(*names: str) -> Column:
    return F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in names))


def merge_triples(triples: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``(<doc>, head, relation, tail, seq)``: each triple of a document once, numbered from 1 in order of first occurrence."""
    from pyspark.sql import Window

    first = triples.groupBy(doc, "head", "relation", "tail").agg(F.min(F.struct(*order)).alias("_o"))
    return first.withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy("_o", "head", "relation", "tail"))).drop("_o")


def normalise_named(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, head, relation, tail)`` from records that name their ends head, source or source_name (tail, target or target_name); incomplete ones go."""
    have = set(df.columns)
    head = [c for c in ("head", "source", "source_name") if c in have]
    tail = [c for c in ("tail", "target", "target_name") if c in have]
    return df.select(*keys, _full(*head).alias("head"), "relation", _full(*tail).alias("tail")).where("head is not null and relation is not null and tail is not null")


def normalise_listed(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """``(<keys>, head, relation, tail)``: the first three of lists with at least three, none of them null."""
    parts = [F.get(F.col(items), i).alias(n) for i, n in enumerate(("head", "relation", "tail"))]
    return df.where(F.size(items) >= 3).select(*keys, *parts).where("head is not null and relation is not null and tail is not null")


def question_triples(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """``(<keys>, pos, head, relation, tail)`` of a question's answer ``{triples: [{subject, relation, object}]}``; subject and relation are needed, a missing object is the unknown."""
    read = F.from_json(answer, "struct<triples:array<struct<subject:string,relation:string,object:string>>>")
    t = df.select(*keys, F.posexplode(read["triples"]).alias("pos", "t"))
    good = (F.coalesce("t.subject", F.lit("")) != "") & (F.coalesce("t.relation", F.lit("")) != "")
    return t.where(good).select(*keys, "pos", F.col("t.subject").alias("head"), "t.relation", F.coalesce("t.object", F.lit("未知")).alias("tail"))
