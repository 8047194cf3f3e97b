"""Hybrid retrieval: exact vector search, then symbolic match, then sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import json_props, split_lines, verbalise
from factloom.operators.vectors import exact_top_k


def hybrid_search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, k: int = 100, least: float = 0.8, symbolic: bool = True) -> DataFrame:
    """Facts for ``queries(q_id, head, tail, vec)``: ``(q_id, r_id, sim, rank)``.

    The ``k`` most similar rows of ``vectors(r_id, vec)`` with similarity ``least`` or more; with ``symbolic`` only
    those whose head or tail in ``graph(r_id, head, tail)`` equals the query's. The match comes after the rank and
    does not widen it.
    """
    hits = exact_top_k(queries, vectors, k, least)
    if not symbolic:
        return hits
    sides = queries.select("q_id", F.col("head").alias("_qh"), F.col("tail").alias("_qt"))
    facts = graph.select("r_id", F.col("head").alias("_h"), F.col("tail").alias("_t"))
    return hits.join(sides, "q_id").join(facts, "r_id").where("_h = _qh or _t = _qt").select("q_id", "r_id", "sim", "rank")


def fact_lines(hits: DataFrame, graph: DataFrame, sentence: Callable[..., Column] = verbalise) -> DataFrame:
    """Sentences of found facts: ``(q_id, r_id, rank, line_no, line)``; evidence with line breaks gives several lines.

    ``sentence`` makes the text from head, relation, tail and their property maps.
    """
    facts = graph.select("r_id", "head", "relation", "tail", *(json_props(c).alias(f"_{c}") for c in ("head_props", "rel_props", "tail_props")))
    text = sentence("head", "relation", "tail", "_head_props", "_rel_props", "_tail_props")
    return hits.join(facts, "r_id").select("q_id", "r_id", "rank", F.posexplode(split_lines(text)).alias("line_no", "line"))
