"""Registered queries of the general training-data operators (problems 1, 2 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import time_text
from factloom.functions.json_arrow import member_columns
from factloom.operators import json_flatten, references
from factloom.operators.time_mixture import normalise_times
from factloom.tables import table


FIRST_DAY, LAST_DAY = "2019-12-29", "2026-01-03"  # local days of instants from 2019-12-30 to 2026-01-02


def _times(spark: SparkSession, folder: str, declared: bool = True) -> DataFrame:
    graph = table(spark, folder, "kg_raw_graph")
    said = member_columns(graph, "rel_props", ["date", "time"], ["row_id", "feed"]).where("is_json")
    order = F.min("date_order") if declared else F.lit(None).cast("string")
    feeds = table(spark, folder, "feeds").groupBy("feed").agg(F.min("zone").alias("zone"), order.alias("date_order"))
    return normalise_times(said.join(feeds, "feed", "left"), "m_date", "m_time", "feed", "zone", "date_order", FIRST_DAY, LAST_DAY)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.coalesce(F.when(~F.col("m_date").rlike(r"(?U)^\s*$"), F.col("m_date")), F.col("m_time"))
    one = F.coalesce(F.col("m_date").rlike(r"(?U)^\s*$"), F.lit(True)) | F.coalesce(F.col("m_time").rlike(r"(?U)^\s*$"), F.lit(True))
    done = one & whole.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return _times(spark, folder).where("instant is not null").where(~done).select("row_id", time_text.iso(F.col("instant")).alias("instant"))


def p1_formats(spark: SparkSession, folder: str) -> DataFrame:
    return _times(spark, folder).groupBy("feed", "time_status", "time_format").agg(F.count("*").alias("n"))


def p1_undeclared(spark: SparkSession, folder: str) -> DataFrame:
    """The orders not declared, so that the mixture alone decides: per feed and format, what it decided by posterior and what stays ambiguous."""
    return _times(spark, folder, False).groupBy("feed", "time_status", "time_format").agg(F.count("*").alias("n"), F.sum((F.col("posterior") < 1).cast("int")).alias("n_by_posterior"), F.min("posterior").alias("least_posterior"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    inner = references.payload_orphans(table(spark, folder, "extraction_result"))
    outer = references.edge_orphans(table(spark, folder, "relationships"), table(spark, folder, "entity"))
    return inner.select(F.lit("relations").alias("tbl"), F.col("extraction_id").alias("rec_id"), "pos", "field", "ref", "reason").union(
        outer.select(F.lit("relationships"), "edge_id", F.lit(0).cast("long"), "field", "ref", "reason")
    )


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    inner = references.payload_orphans(table(spark, folder, "extraction_result"))
    outer = references.edge_orphans(table(spark, folder, "relationships"), table(spark, folder, "entity"))
    return references.orphan_report(inner, "relations").union(references.orphan_report(outer, "relationships"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "extraction_result").select("extraction_id", "payload").dropDuplicates()
    inner = json_flatten.flat_scalars(results, "extraction_id", "payload", json_flatten.under_members({"attributes": ("entities", "relations")}), lenient=True)
    graph = table(spark, folder, "kg_raw_graph")
    outer = json_flatten.flat_scalars(graph, "row_id", "rel_props", json_flatten.under_containers)
    return inner.select(F.lit("extraction_result").alias("tbl"), F.col("extraction_id").alias("rec_id"), "parent", "field", "val").union(
        outer.select(F.lit("kg_raw_graph"), "row_id", "parent", "field", "val")
    )


def p4_nodes(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "extraction_result").select("extraction_id", "payload").dropDuplicates()
    return json_flatten.node_table(results, "extraction_id", "payload", lenient=True)


QUERIES = {"p1_found": p1_found, "p1_formats": p1_formats, "p1_undeclared": p1_undeclared, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p4_nodes": p4_nodes}
_OBJECT = r"""regexp_replace(regexp_extract(payload, '(?s)\{.*\}'), ',\s*([}\]])', '\1', 'g')"""
_READ = rf"""x as (select distinct extraction_id, doc_id, round_no, {_OBJECT} b from extraction_result where payload is not null), g as (select * from x where b <> '' and json_valid(b) and json_type(b) = 'OBJECT')"""
_ORPHANS = rf"""{_READ},
  own as (select extraction_id, doc_id, round_no, upper(trim(unnest(json_extract_string(b, '$.entities[*].id')))) id from g),
  rel as (select extraction_id, doc_id, round_no, unnest(json_extract(b, '$.relations[*]')) r, generate_subscripts(json_extract(b, '$.relations[*]'), 1) - 1 pos from g),
  two as (select *, 'source' field, r->'source' v from rel union all select *, 'target', r->'target' from rel),
  one as (select extraction_id, doc_id, round_no, pos, field, unnest(case when json_type(v) = 'ARRAY' then json_extract_string(v, '$[*]') when json_type(v) = 'NULL' then [] else [v->>'$'] end) s from two where v is not null),
  ref as (select distinct extraction_id, doc_id, round_no, pos, field, upper(trim(unnest(string_split_regex(s, '[,、]')))) ref from one where s is not null),
  gone as (select * from ref where ref <> '' and not exists (select 1 from own where own.extraction_id = ref.extraction_id and own.id = ref.ref)),
  ent as (select distinct name, loaded_at a, deleted_at d from entity), ed as (select distinct edge_id, loaded_at, unnest([{{f: 'source_name', n: source_name}}, {{f: 'target_name', n: target_name}}]) e from relationships)"""
_FOUND = rf"""{_ORPHANS}, found as (select 'relations' tbl, extraction_id rec_id, pos::bigint pos, field, ref, case when exists (select 1 from own where own.doc_id = gone.doc_id and own.id = gone.ref and own.round_no > gone.round_no) then 'late' else 'missing' end reason, null::timestamp seen from gone
      union all select 'relationships', edge_id, 0, e.f, e.n, case when a is null then 'missing' when a > loaded_at then 'late' else 'deleted' end, loaded_at
      from ed left join ent on ent.name = e.n where not regexp_full_match(e.n, '[\t-\r\x{{85}}\p{{Z}}]*') and (a is null or a > loaded_at or d <= loaded_at))"""
SQL: dict[str, str] = {
    "p4_nodes": rf"""with {_READ}, one as (select distinct extraction_id, b from g), tr as (select one.extraction_id, t.*, row_number() over (partition by one.extraction_id order by t.id) - 1 node from one, json_tree(one.b) t),
      up as (select extraction_id, id, node parent_node from tr)
      select tr.extraction_id, node, parent_node, len(regexp_extract_all(substr(fullkey, 2), '\[\d+\]|\."[^"]*"|\.[^.\[]+'))::int depth, regexp_replace(substr(fullkey, 3), '(^|\.)"([^"]*)"', '\1\2', 'g') path,
        case when fullkey = path || '[' || key || ']' then '[' || key || ']' else key end field, case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' else 'literal' end kind,
        case when type in ('OBJECT', 'ARRAY') then null when type = 'VARCHAR' then atom->>'$' else coalesce(atom::varchar, 'null') end val
      from tr left join up on up.extraction_id = tr.extraction_id and up.id = tr.parent""",
    "p4_found": rf"""with {_READ},
      tr as (select g.extraction_id rec, null::varchar pre, t.* from g, json_tree(g.b) t),
      sub as (select rec, substr(fullkey, 3) pre, atom->>'$' a from tr where type = 'VARCHAR' and regexp_full_match(fullkey, '\$\.(entities|relations)\[\d+\]\.attributes')),
      inn as (select sub.rec, sub.pre, t.* from sub, json_tree(case when json_valid(sub.a) and json_type(sub.a) in ('OBJECT', 'ARRAY') then sub.a else 'null' end) t),
      kg as (select row_id rec, null::varchar pre, t.* from (select row_id, case when json_valid(rel_props) and json_type(rel_props) = 'OBJECT' then rel_props else 'null' end j from kg_raw_graph) k, json_tree(k.j) t),
      al as (select 'extraction_result' tbl, * from tr where regexp_matches(fullkey, '^\$\.(entities|relations)\[\d+\]\.attributes[.\[]') union all select 'extraction_result', * from inn where fullkey <> '$' union all select 'kg_raw_graph', * from kg where path <> '$')
      select distinct tbl, rec rec_id, regexp_replace(case when pre is null then substr(path, 3) when path = '$' then pre else pre || substr(path, 2) end, '(^|\.)"([^"]*)"', '\1\2', 'g') parent, case when fullkey = path || '[' || key || ']' then '[' || key || ']' else key end field, case when type = 'VARCHAR' then atom->>'$' else atom::varchar end val from al where type not in ('OBJECT', 'ARRAY', 'NULL')""",
    "p2_found": f"with {_FOUND} select tbl, rec_id, pos, field, ref, reason from found",
    "p2_report": f"""with {_FOUND}, told as (select distinct extraction_id, loaded_at from extraction_result)
      select tbl, strftime(coalesce(seen, loaded_at), '%Y-%m') "month", field, reason, count(*) n from found left join told on tbl = 'relations' and extraction_id = rec_id group by all""",
}
