"""Registered queries of the fact-checking operators, each over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import vectors as vf
from factloom.operators import dedup, graph, report, search, triples, vectors
from factloom.plans import pipelines
from factloom.plans.core_sql import SQL  # noqa: F401
from factloom.providers import HashingEncoder, ReplayAnswers
from factloom.session import shared_folder
from factloom.sources import files
from factloom.tables import table

Q = {}
#: Day that parts the edge log into what is there and what is new.
CUT = "2024-07-01"


def query(f):
    Q[f.__name__] = f
    return f


def _six(c: Column) -> Column:
    return F.round(c, 6)


def _read(s: SparkSession, d: str) -> DataFrame:
    return graph.read_results(table(s, d, "extraction_result"), ["extraction_id", "doc_id", "round_no"])


KEYS = ["extraction_id"]


@query
def scan_project(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kg_raw_graph").where("head <> '' and tail <> ''").select("row_id", "head", "relation", "tail")


@query
def document_scan(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", tx.strip_text("text").alias("text"))


@query
def first_document(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_in").orderBy("doc_id", "text").limit(1).select("doc_id", "text")


@query
def id_from_path(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("file:/in/box/news_kg_"), "doc_id", F.lit(".txt"))
    return table(s, d, "news_in").select(tx.id_from_path(path).alias("doc_id")).distinct()


@query
def vector_normalize(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "kg_vectors").select("row_id", vf.unit(F.col("embedding")).alias("u")).where("u is not null")
    return v.select("row_id", _six(F.get("u", 0)).alias("first"), _six(F.element_at("u", -1)).alias("last"), _six(vf.norm(F.col("u"))).alias("length"))


@query
def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "kg_vectors").select("row_id", "embedding")
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("next"))
    return a.join(b, "row_id").select("row_id", _six(vf.cosine(F.col("embedding"), F.col("next"))).alias("sim")).where("sim is not null")


def _embeddings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("vec"))


@query
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return vectors.exact_top_k(*_embeddings(s, d), k=100).select("q_id", "r_id", _six(F.col("sim")).alias("sim"), "rank")


@query
def vector_topk_threshold(s: SparkSession, d: str) -> DataFrame:
    return vectors.exact_top_k(*_embeddings(s, d), k=100, least=0.3).select("q_id", "r_id", _six(F.col("sim")).alias("sim"), "rank")


def _kg(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kg = table(s, d, "kg_raw_graph").withColumnRenamed("row_id", "r_id")
    return kg, table(s, d, "kg_vectors").select(F.col("row_id").alias("r_id"), F.col("embedding").alias("vec")).where("vec is not null")


def _hits(s: SparkSession, d: str, symbolic: bool) -> DataFrame:
    kg, vec = _kg(s, d)
    asked = kg.join(vec, "r_id").where("r_id % 20 = 0").select(F.col("r_id").alias("q_id"), "head", "tail", "vec")
    return search.hybrid_search(asked, kg, vec, k=100, least=0.8, symbolic=symbolic)


@query
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, True).select("q_id", "r_id", _six(F.col("sim")).alias("sim"), "rank")


@query
def vector_search(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, False).select("q_id", "r_id", _six(F.col("sim")).alias("sim"), "rank")


def _bucketed(s: SparkSession, d: str) -> DataFrame:
    text = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("line"))
    e = table(s, d, "embeddings").join(text, "vec_id", "left")
    return e.select((F.col("vec_id") - F.pmod("vec_id", F.lit(100))).alias("doc"), F.col("label").alias("bucket"), F.col("vec_id").alias("seq"), F.coalesce("line", F.lit("")).alias("line"), F.col("embedding").alias("vec"))


@query
def dedup_keep_first(s: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(_bucketed(s, d), ["doc", "bucket"], 0.2).select("doc", "bucket", "seq")


@query
def dedup_keep_longest(s: SparkSession, d: str) -> DataFrame:
    return dedup.keep_longest(_bucketed(s, d), ["doc", "bucket"], 0.2).select("doc", "bucket", "seq", F.length("line").cast("bigint").alias("n_chars"))


@query
def mean_pool(s: SparkSession, d: str) -> DataFrame:
    return vectors.mean_pool(table(s, d, "embeddings"), "label", "embedding").select("label", F.posexplode("vec").alias("dim", "m")).select("label", "dim", _six(F.col("m")).alias("mean"))


@query
def sliding_chunks(s: SparkSession, d: str) -> DataFrame:
    return vectors.sliding_chunks(table(s, d, "documents"), "doc_id", "text")


def _payloads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extraction_result").select("extraction_id", "payload").dropDuplicates()


@query
def clean_json_fence(s: SparkSession, d: str) -> DataFrame:
    return _payloads(s, d).select("extraction_id", tx.clean_json_fence("payload").alias("payload"))


@query
def safe_json(s: SparkSession, d: str) -> DataFrame:
    return _payloads(s, d).select("extraction_id", tx.safe_json("payload").alias("payload"))


@query
def first_json_object(s: SparkSession, d: str) -> DataFrame:
    return _payloads(s, d).select("extraction_id", tx.first_json_object("payload").alias("payload"))


@query
def extract_json_block(s: SparkSession, d: str) -> DataFrame:
    return _payloads(s, d).select("extraction_id", tx.extract_json_block("payload").alias("payload"))


@query
def json_props(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "kg_raw_graph").select("row_id", tx.json_props("rel_props").alias("p"))
    return p.select("row_id", F.col("p")["doc_id"].alias("doc_id"), F.col("p")["date"].alias("date"), F.size("p").cast("bigint").alias("n_props"))


@query
def entity_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.entity_nodes(_read(s, d), KEYS).select(*KEYS, "pos", "id", "name", "type", F.size("props").cast("bigint").alias("n_props"))


@query
def relation_expand(s: SparkSession, d: str) -> DataFrame:
    return graph.relation_ends(_read(s, d), KEYS).select(*KEYS, "pos", "source", "target")


@query
def relation_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.relation_edges(_read(s, d), KEYS).select(*KEYS, "pos", "source_name", "relation", "target_name", "evidence")


@query
def valid_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.valid_edges(table(s, d, "relationships")).select("edge_id", "source_name", "relation", "target_name").distinct()


@query
def resolve_triples(s: SparkSession, d: str) -> DataFrame:
    return graph.resolve_triples(_read(s, d), KEYS)


@query
def normalize_triples(s: SparkSession, d: str) -> DataFrame:
    named = triples.normalise_named(table(s, d, "relationships"), ["edge_id"]).distinct()
    kg = table(s, d, "kg_raw_graph").select("row_id", F.array("head", "relation", "tail").alias("items"))
    return named.union(triples.normalise_listed(kg, ["row_id"], "items"))


@query
def question_triples(s: SparkSession, d: str) -> DataFrame:
    asked = F.struct(F.col("head").alias("subject"), "relation", F.when(F.col("row_id") % 3 > 0, F.col("tail")).alias("object"))
    kg = table(s, d, "kg_raw_graph").select("row_id", F.to_json(F.struct(F.array(asked).alias("triples"))).alias("answer"))
    return triples.question_triples(kg, ["row_id"], "answer").select("row_id", "head", "relation", "tail")


@query
def merge_triples(s: SparkSession, d: str) -> DataFrame:
    found = graph.resolve_triples(_read(s, d), ["extraction_id", "doc_id", "round_no"])
    return triples.merge_triples(found, "doc_id", ["round_no", "extraction_id", "pos"])


@query
def triple_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kg_raw_graph").groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("head").alias("n_heads"))


@query
def edge_evidence_count(s: SparkSession, d: str) -> DataFrame:
    return graph.evidence_counts(table(s, d, "relationships"))


@query
def node_upsert(s: SparkSession, d: str) -> DataFrame:
    kg = table(s, d, "kg_raw_graph").select(F.col("head").alias("name"), tx.json_props("head_props").alias("p"), F.col("row_id").alias("seq"), "feed")
    log = kg.select("name", F.col("p")["id"].alias("id"), F.col("p")["type"].alias("type"), F.map_filter("p", lambda k, v: ~k.isin("id", "type")).alias("props"), "seq", "feed")
    old, new = log.where("feed = 'taipei_desk'").drop("feed"), log.where("feed <> 'taipei_desk'").drop("feed")
    text = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|")
    return graph.node_upsert(old, new).select("name", "id", "type", text.alias("props"))


@query
def edge_dedup_load(s: SparkSession, d: str) -> DataFrame:
    log, nodes = table(s, d, "relationships"), table(s, d, "entity")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return graph.edge_load(log.where(F.col("loaded_at") < cut), log.where(F.col("loaded_at") >= cut), nodes, "edge_id").select("edge_id")


@query
def graph_export(s: SparkSession, d: str) -> DataFrame:
    edges = table(s, d, "relationships").dropDuplicates(["edge_id"])
    g = graph.graph_export(edges, graph.current_nodes(table(s, d, "entity")))
    return g.select("head", "relation", "tail", F.get_json_object("rel_props", "$.date").alias("date"), F.get_json_object("head_props", "$.type").alias("head_type"), F.get_json_object("tail_props", "$.id").alias("tail_id"))


def _sentences(s: SparkSession, d: str) -> DataFrame:
    kg = table(s, d, "kg_raw_graph").select("row_id", "head", "relation", "tail", *(tx.json_props(c).alias(c) for c in ("head_props", "rel_props", "tail_props")))
    text = tx.verbalise("head", "relation", "tail", "head_props", "rel_props", "tail_props")
    return kg.select("row_id", F.coalesce(F.col("rel_props")["doc_id"], F.lit("")).alias("doc"), text.alias("line"))


@query
def format_props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kg_raw_graph").select("row_id", tx.format_props(tx.json_props("tail_props")).alias("shown"))


@query
def verbalize(s: SparkSession, d: str) -> DataFrame:
    return _sentences(s, d).select("row_id", "line")


@query
def split_lines(s: SparkSession, d: str) -> DataFrame:
    return _sentences(s, d).select("row_id", F.posexplode(tx.split_lines("line")).alias("line_no", "line"))


@query
def triple_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kg_raw_graph").select("row_id", tx.triple_text("head", "relation", "tail").alias("text"))


@query
def entity_key_full(s: SparkSession, d: str) -> DataFrame:
    return _sentences(s, d).select("row_id", tx.entity_key_full("line").alias("bucket"))


@query
def entity_key_name(s: SparkSession, d: str) -> DataFrame:
    return _sentences(s, d).select("row_id", tx.entity_key_name("line").alias("bucket"))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    lines = _sentences(s, d).select("row_id", "doc", F.posexplode(tx.split_lines("line")).alias("line_no", "line"))
    return dedup.renumber(lines, "doc", ["row_id", "line_no"])


@query
def renumber_lines(s: SparkSession, d: str) -> DataFrame:
    n = _numbered(s, d)
    return n.select("doc", "n", "text", tx.renumber_prefix("line", F.col("n")).alias("prefixed"))


@query
def report_assembly(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "news_in").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return report.assemble(docs, _numbered(s, d).select("doc", "n", "text"), "doc")


@query
def parse_request_date(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "relationships").select("edge_id", tx.request_date("date").cast("string").alias("day")).distinct()


@query
def merge_date_text(s: SparkSession, d: str) -> DataFrame:
    day = F.substring(F.col("published_at").cast("string"), 1, 10)
    return table(s, d, "news_in").select("doc_id", tx.dated_text(day, F.coalesce("text", F.lit(""))).alias("text")).distinct()


@query
def run_id_format(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_in").select("doc_id", tx.run_id(F.substring(F.col("published_at").cast("string"), 1, 10), "loaded_at").alias("run_id")).distinct()


@query
def validate_requests(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", tx.request_status("text", "source", F.col("doc_kind") == "question").alias("status"))


@query
def parse_label(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("lang") == "en", F.col("n_chars").cast("int"))
    return table(s, d, "documents").select("doc_id", tx.parse_label(label, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("lang"))), F.coalesce("source", F.lit("Fake_News"))).cast("bigint").alias("label"))


@query
def incremental_anti(s: SparkSession, d: str) -> DataFrame:
    return files.pending(table(s, d, "news_in").select("doc_id").distinct(), table(s, d, "extraction_result").select("doc_id"))


@query
def pipeline_status(s: SparkSession, d: str) -> DataFrame:
    found = graph.resolve_triples(_read(s, d), ["doc_id", "extraction_id"])
    return report.status(table(s, d, "news_in"), found, table(s, d, "relationships"), "doc_id")


def _checked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, HashingEncoder, DataFrame, DataFrame]:
    kg, _ = _kg(s, d)
    encoder = HashingEncoder()
    answers = table(s, d, "extraction_result").select("doc_id", "round_no", F.col("payload").alias("raw")).dropDuplicates()
    news = table(s, d, "news_in").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    vec = encoder.encode(kg.select("r_id", tx.triple_text("head", "relation", "tail").alias("t")), "t").where("vec is not null").select("r_id", "vec")
    return news, answers, encoder, kg, vec


@query
def verify_report(s: SparkSession, d: str) -> DataFrame:
    news, answers, encoder, kg, vec = _checked(s, d)
    return pipelines.verify(news, ReplayAnswers(answers), encoder, kg, vec, k=100, least=0.8)


def _asked(s: SparkSession, d: str, answers: DataFrame) -> ReplayAnswers:
    """Answers of the second round as a list of triples, the others as entities and relations."""
    keys = ["doc_id", "round_no"]
    read = graph.read_results(answers.where("round_no = 2").withColumnRenamed("raw", "payload"), keys)
    one = F.struct("pos", F.col("head").alias("subject"), "relation", F.col("tail").alias("object"))
    told = graph.resolve_triples(read, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("triples"))
    told = told.select(*keys, F.to_json(F.struct(F.transform("triples", lambda t: F.struct(t["subject"].alias("subject"), t["relation"].alias("relation"), t["object"].alias("object"))).alias("triples"))).alias("raw"))
    return ReplayAnswers(answers.where("round_no <> 2").unionByName(told))


@query
def answer_report(s: SparkSession, d: str) -> DataFrame:
    news, answers, encoder, kg, vec = _checked(s, d)
    return pipelines.answer(news, _asked(s, d, answers), encoder, kg, vec, k=100, least=0.8)


@query
def asked_triples(s: SparkSession, d: str) -> DataFrame:
    news, answers, *_ = _checked(s, d)
    return pipelines.asked_triples(news, _asked(s, d, answers)).select("doc_id", "head", "relation", "tail")


@query
def unreadable_rounds(s: SparkSession, d: str) -> DataFrame:
    news, answers, *_ = _checked(s, d)
    return pipelines.read_rounds(news, ReplayAnswers(answers))[1].select("doc_id", "round_no", "raw", "reason")


def _built(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    answers = table(s, d, "extraction_result").select("doc_id", F.col("extraction_id").alias("seq"), "payload").dropDuplicates()
    return pipelines.build_graph(answers, graph.current_nodes(table(s, d, "entity")), table(s, d, "relationships"))


@query
def build_graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return _built(s, d)[0].select("name", "id", "type", F.size("props").cast("bigint").alias("n_props"))


@query
def build_graph_edges(s: SparkSession, d: str) -> DataFrame:
    return _built(s, d)[1]


@query
def embed_graph(s: SparkSession, d: str) -> DataFrame:
    kg, _ = _kg(s, d)
    return pipelines.embed_graph(kg, HashingEncoder(), props=True).select("r_id", F.size("vec").alias("size"))


@query
def token_chunks(s: SparkSession, d: str) -> DataFrame:
    return vectors.token_chunks(table(s, d, "documents"), "doc_id", "text")


@query
def sub_questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("doc_kind = 'question'").select("doc_id", F.posexplode(tx.sub_questions("text")).alias("pos", "question"))


@query
def answer_faults(s: SparkSession, d: str) -> DataFrame:
    return graph.answer_faults(_read(s, d), KEYS)


@query
def decode_upload(s: SparkSession, d: str) -> DataFrame:
    sent = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return table(s, d, "documents").where("text is not null").select("doc_id", files.decode_upload(sent).alias("text"))


@query
def resolve_document(s: SparkSession, d: str) -> DataFrame:
    """The file of the greatest document id, asked for by its bare name, where the same name lies in the inbox and in two other folders."""
    news = table(s, d, "news_in").select("doc_id", "text").distinct()
    last = news.agg(F.max("doc_id")).head()[0]
    paths = news.select(F.explode(F.array(*(F.concat(F.lit(f"/{box}/"), "doc_id", F.lit(".txt")) for box in ("old", "in", "archive")))).alias("path"), "text")
    return files.resolve_document(paths, f"{last}.txt", "/in").select("path")


@query
def triples_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Triples to CSV and back."""
    path = f"{shared_folder(s)}/factloom-csv-{uuid.uuid4().hex}"
    files.write_triples(table(s, d, "kg_raw_graph"), path)
    return files.read_triples(s, path)


def _verdicts(s: SparkSession, d: str) -> tuple[DataFrame, ReplayAnswers]:
    """Reports of as many knowledge lines as an edge's id modulo 7, and verdicts on them whose points name the edge's ends."""
    edges = table(s, d, "relationships").select("edge_id", "source_name", "target_name").dropDuplicates(["edge_id"]).where("source_name not rlike '[\\\\n\\\\r]' and target_name not rlike '[\\\\n\\\\r]'")
    doc, n = F.col("edge_id").cast("string").alias("doc_id"), F.col("edge_id") % 7
    report_ = F.concat(F.lit("```\n[比對知識]\n"), F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] x"))), "\n"), F.lit("\n```"))
    raw = F.concat(F.lit("```\n一、查核明細\n✅ 一致\n1. 甲"), "source_name", F.lit("；`[1]`[2][2]\n\n❌ 矛盾\n2. 乙"), "target_name", F.lit("；`[9]`\n二、總結\n1. 無\n三、評分\n"), (n + 5).cast("string"), F.lit("分\n```"))
    return edges.select(doc, report_.alias("report")), ReplayAnswers(edges.select(doc, F.lit(1).alias("round_no"), raw.alias("raw")))


@query
def verdict_points(s: SparkSession, d: str) -> DataFrame:
    points = pipelines.judge(*_verdicts(s, d))[1]
    return points.select("doc_id", "label", "item_no", "text", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))


@query
def verdict_scores(s: SparkSession, d: str) -> DataFrame:
    return pipelines.judge(*_verdicts(s, d))[0].select("doc_id", "score")


QUERIES = Q
