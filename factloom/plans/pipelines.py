"""The dataflows end to end: building a graph and its vectors, checking news, answering questions, reading verdicts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import entity_key_full, entity_key_name, extract_json_block, payload_object, renumber_bracket, renumber_prefix, safe_json, triple_text, verbalise
from factloom.operators import dedup, graph, report, search, triples, vectors, verdict
from factloom.providers import Answers, Encoder
from factloom.session import discard, settled, written


def build_graph(answers: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and new edges after answers ``(doc_id, seq, payload)`` are merged into ``nodes`` and ``edges``.

    An answer is read from its first brace to its last; if that is no JSON, from its code fence or first balanced object.

    Edges are ``(source_name, target_name, relation, evidence, doc_id, date)``; attributes of a relation named so replace
    what else is known of it. The document of an edge is the answer's where its attributes name none.
    """
    told = answers.withColumn("payload", F.coalesce(payload_object("payload"), extract_json_block("payload")))
    read = graph.read_results(told, ["doc_id", "seq"])
    place = lambda seq, doc, pos: F.struct(seq.cast("bigint").alias("a"), doc.cast("string").alias("b"), pos.cast("int").alias("c"))
    made = graph.entity_nodes(read, ["doc_id", "seq"]).select("name", "id", "type", "props", place(F.col("seq"), F.col("doc_id"), F.col("pos")).alias("seq"))
    old = nodes.select("name", "id", "type", "props", place(F.lit(None), F.lit(None), F.lit(None)).alias("seq"))
    merged = graph.node_upsert(old, made)
    linked = graph.relation_edges(read, ["doc_id", "seq"]).withColumn("_s", F.struct("seq", "doc_id", "pos", "source", "target"))
    linked = linked.withColumn("doc_id", F.coalesce(F.col("props")["doc_id"], F.col("doc_id").cast("string"))).withColumn("date", F.col("props")["date"])
    new = graph.edge_load(edges, linked, merged, "_s")
    return merged, new.select("source_name", "target_name", "relation", "evidence", "doc_id", "date")


def embed_graph(kg: DataFrame, encoder: Encoder, props: bool = False, window: int = 510, stride: int = 256, tokens: Callable[[Column], Column] = vectors.token_pieces) -> DataFrame:
    """``(r_id, vec)`` of triples ``(r_id, head, relation, tail, <props>)``: the mean over the encoded windows of a triple's text."""
    shown = ["head_props", "rel_props", "tail_props"] if props else []
    chunks = vectors.token_chunks(kg.select("r_id", triple_text("head", "relation", "tail", *shown).alias("_t")), "r_id", "_t", window, stride, tokens)
    return vectors.mean_pool(encoder.encode(chunks, "chunk"), "r_id", "vec")


def read_rounds(docs: DataFrame, llm: Answers) -> tuple[DataFrame, DataFrame]:
    """Answers that can be read, ``(doc_id, round_no, payload)``, and the others, ``(doc_id, round_no, raw, reason)``."""
    got = written(llm.answer(docs).select("doc_id", "round_no", "raw", safe_json("raw").alias("payload")), "rounds")
    reason = F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "EMPTY").otherwise("NOT_JSON")
    return got.where("payload is not null").drop("raw"), got.where("payload is null").select("doc_id", "round_no", "raw", reason.alias("reason"))


def news_triples(docs: DataFrame, llm: Answers) -> DataFrame:
    """``(doc_id, head, relation, tail, seq)``: the triples of a news text's rounds, each once."""
    read = written(graph.read_results(read_rounds(docs, llm)[0], ["doc_id", "round_no"]), "results")
    return triples.merge_triples(graph.resolve_triples(read, ["doc_id", "round_no"]), "doc_id", ["round_no", "pos"])


def asked_triples(docs: DataFrame, llm: Answers) -> DataFrame:
    """``(doc_id, head, relation, tail, seq)`` of a question's rounds; answers without a list of triples are read as entities and relations."""
    got = read_rounds(docs, llm)[0]
    listed = F.coalesce(F.array_contains(F.json_object_keys("payload"), "triples"), F.lit(False))
    keys = ["doc_id", "round_no"]
    told = triples.question_triples(got.where(listed), keys, "payload")
    linked = graph.resolve_triples(written(graph.read_results(got.where(~listed), keys), "results"), keys)
    return triples.merge_triples(told.unionByName(linked), "doc_id", ["round_no", "pos"])


def verify(docs: DataFrame, llm: Answers, encoder: Encoder, kg: DataFrame, vectors: DataFrame, k: int = 100, least: float = 0.8, same: float = 0.8) -> DataFrame:
    """Reports and status of news ``(doc_id, text)``: ``(doc_id, status, report)``.

    Rounds of answers are merged, each triple searched with symbolic match, sentences put in buckets by their first
    entity with its properties, the first of similar ones kept.
    """
    return _report(docs, lambda: news_triples(docs, llm), encoder, kg, vectors, k, least, same, True, report.NEWS)


def answer(docs: DataFrame, llm: Answers, encoder: Encoder, kg: DataFrame, vectors: DataFrame, k: int = 100, least: float = 0.8, same: float = 0.8) -> DataFrame:
    """Reports and status of questions: vector search only, buckets by bare entity name, the longest of similar lines kept."""
    return _report(docs, lambda: asked_triples(docs, llm), encoder, kg, vectors, k, least, same, False, report.QUESTION)


def _report(docs, found, encoder, kg, vectors, k, least, same, news, headings, sentence=verbalise) -> DataFrame:
    spark = docs.sparkSession
    found = settled(found, "triples")
    who = written(found.select("doc_id").distinct().where("doc_id is not null").withColumn("d", F.monotonically_increasing_id()), "who")
    said = ["head", "relation", "tail"]
    asked = encoder.encode(found.select(*said).distinct().withColumn("_text", triple_text(*said)), "_text")
    asked = written(asked.where("vec is not null").withColumn("q_id", F.monotonically_increasing_id()), "asked")  # each triple once, whoever asks; written, so ids stay
    hits = settled(lambda: search.hybrid_search(asked, kg, vectors, k, least, symbolic=news).select("q_id", "r_id", "rank"), "hits")
    key = entity_key_full if news else entity_key_name
    lines = search.fact_lines(hits.select("r_id").distinct().withColumns({"q_id": F.lit(0), "rank": F.lit(0)}), kg, sentence).select("r_id", "line_no", "line", key("line").alias("bucket"))
    lines = written(encoder.encode(lines, "line").withColumn("line_id", F.monotonically_increasing_id()), "lines")  # each fact once
    spots = written(lines.select("r_id", "line_no", "line_id", F.min("line_id").over(Window.partitionBy("bucket")).alias("b")), "spots")
    # ids alone meet the documents: vectors and texts stay with the lines
    met = written(hits.join(spots, "r_id").select("q_id", "rank", "line_no", "r_id", "line_id", "b"), "met")
    discard(hits)
    asks = found.join(who, "doc_id").select("d", "seq", *said).join(asked.select(*said, "q_id"), said).select("q_id", "d", "seq")
    wanted = asks.join(met, "q_id").repartition("d")
    first = wanted.groupBy("d", "line_id").agg(F.min(F.struct("seq", "rank", "line_no", "r_id")).alias("_o"), F.first("b").alias("b"))  # a repeated line is like its first
    placed = first.withColumn("seq", F.row_number().over(Window.partitionBy("d").orderBy("_o.seq", "_o.rank", "_o.line_no", "_o.r_id")).cast("bigint"))
    placed = written(placed.select("d", "seq", "b", "line_id"), "placed")
    discard(met, asked)
    of_bucket = lines.join(spots.select("line_id", "b"), "line_id").select("line_id", "b", F.length("line").alias("n_chars"), "vec")
    kept = dedup.fold_ids(placed, of_bucket, same, not news)
    kept = written(kept.select("d", "line_id", F.row_number().over(Window.partitionBy("d").orderBy("seq")).alias("n")), "kept")
    discard(placed, spots)

    style = renumber_bracket if news else renumber_prefix
    numbered = F.col("line").rlike(r"(?U)^\d+\.") if news else F.lit(True)
    text = F.when(numbered, F.substr(style("line", F.lit(0)), F.lit(4))).otherwise(F.col("line"))  # without its [0]
    told = kept.join(lines.select("line_id", numbered.alias("numbered"), text.alias("text")), "line_id")
    have = docs.select("doc_id", "text").join(who, "doc_id").join(kept.select("d").distinct(), "d", "left_semi")
    size = lines.agg(F.avg(F.octet_length("line"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(kept.count() * size / report.PART))
    made = report.packed_reports(have, told, "doc_id", parts, headings).select("doc_id", F.lit("OK").alias("status"), "report")
    rest = report.status(docs, found, kept.select("d").distinct().join(who, "d"), "doc_id").where("status <> 'OK'")
    return made.unionByName(rest.withColumn("report", F.lit(None).cast("string")))


def judge(reports: DataFrame, llm: Answers) -> tuple[DataFrame, DataFrame]:
    """Verdicts or answers on reports ``(doc_id, report)``: ``(doc_id, round_no, score, raw)``, and their points ``(doc_id, round_no, label, item_no, text, cited)``.

    Only numbers of the report's own knowledge lines count as cited.
    """
    raw = llm.answer(reports.where("report is not null").select("doc_id", F.col("report").alias("text")))
    known = reports.select("doc_id", verdict.knowledge_lines("report").alias("n_known"))
    points = verdict.points(raw.join(known, "doc_id", "left"), ["doc_id", "round_no"], "raw", "n_known")
    return raw.select("doc_id", "round_no", verdict.score("raw").alias("score"), "raw"), points
