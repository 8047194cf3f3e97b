"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.json_arrow import member_columns
from factloom.llm import looks, mixing, names, neardup, neighbours, split, tokens
from factloom.llm.sql import SQL  # noqa: F401
from factloom.session import written
from factloom.tables import table

TOKENIZER = "byte_bpe_50k"


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    graph = table(spark, folder, "kg_raw_graph")
    return names.canonical_forms(names.spellings(table(spark, folder, "entity").select("name"), graph.select("head"), graph.select("tail")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_entity_pairs(_forms(spark, folder))


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.mutual(neighbours.nearest(table(spark, folder, "kg_vectors"), "row_id", "embedding", k=5, least=0.8))


def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector is indexed; queries are the rows whose id is divisible by 20. Half of the neighbours are distant ones: hence probes by recall."""
    return neighbours.nearest(table(spark, folder, "kg_vectors"), "row_id", "embedding", k=5, prefix=2, depth=None, per_pivot=1024, recall=0.93, asked=lambda i: i % 20 == 0)


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "relationships").select(F.col("edge_id").alias("rec"), "evidence")
    graph = member_columns(table(spark, folder, "kg_raw_graph"), "rel_props", ["evidence"], ["row_id"]).where("is_json")
    return edges.union(graph.select("row_id", "m_evidence")).where("evidence is not null")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.record_pairs(*neardup.near_duplicates(_evidence(spark, folder), "rec", "evidence"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(_evidence(spark, folder), "rec", "evidence"))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    news = table(spark, folder, "news_in").where(F.length("text") > 600).select("doc_id", "text").dropDuplicates()
    news = news.select(F.lit("news_in").alias("tbl"), F.col("doc_id").alias("item_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    props = split.text_members(table(spark, folder, "kg_raw_graph"), "row_id", "head_props", 600)
    props = props.select(F.lit("kg_raw_graph").alias("tbl"), F.col("row_id").cast("string").alias("item_id"), "field", "value")
    return split.split_items(news.union(props), ["tbl", "item_id", "field"], "value")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_pieces(spark, folder).where("piece_no = 0").select("tbl", "item_id", "field", F.col("hard").cast("bigint").alias("hard"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text", TOKENIZER)


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode_corpus(p8_ids(spark, folder), "doc_id", "ids", TOKENIZER)


def _sizes(spark: SparkSession, folder: str, *levels: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets").select("source").distinct()
    docs = table(spark, folder, "documents").join(F.broadcast(targets), "source", "left_semi")
    return written(tokens.count_tokens(docs, ["doc_id", "source", *levels], "text", TOKENIZER), "sizes")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(_sizes(spark, folder), table(spark, folder, "mix_targets")).where("not reachable").select("source")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _sizes(spark, folder)
    return mixing.mix(sizes, mixing.plan(sizes, table(spark, folder, "mix_targets")), "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _sizes(spark, folder)
    planned = mixing.plan(sizes, table(spark, folder, "mix_targets"))
    return mixing.shares(mixing.mix(sizes, planned, "doc_id"), planned)


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture through a tree of kind of document, language and source: what a leaf lacks goes to its siblings first."""
    sizes, targets = mixing.by_levels(_sizes(spark, folder, "doc_kind", "lang"), table(spark, folder, "mix_targets"), ["doc_kind", "lang"])
    planned = mixing.plan(sizes, targets, levels=["doc_kind", "lang"])
    used = mixing.shares(mixing.mix(sizes, planned, "doc_id"), planned)
    return planned.select(F.col("source").alias("leaf"), "tokens", "wanted", "budget").join(used.select(F.col("source").alias("leaf"), "actual_share", "tokens_used", "epochs"), "leaf")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return looks.same_look_pairs(table(spark, folder, "documents"), "doc_id", "text")


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    return looks.one_form(table(spark, folder, "documents"), "doc_id", "text").drop("chars")


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms, "p5_found": p5_found, "p5_nearest": p5_nearest, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_levels": p9_levels, "p10_found": p10_found, "p10_forms": p10_forms}
