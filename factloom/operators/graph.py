"""Extraction results to graph nodes and edges, and their upsert and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import ensure_list, json_props, payload_object

# What stands for a missing type of a node and of an edge.
NODE_TYPE, EDGE_TYPE = "Entity", "RELATED_TO"
_MEMBER = "struct<id:string,name:string,type:string,attributes:string>"
_LINK = "struct<source:string,relation:string,type:string,target:string,evidence:string,attributes:string>"
PAYLOAD = f"struct<entities:array<{_MEMBER}>,relations:array<{_LINK}>>"


def read_results(results: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """``(<keys>, result)`` of the answers that can be read, each once; nested attributes stay JSON text."""
    body = results.select(*keys, payload_object(payload).alias("_b")).where("_b is not null").dropDuplicates()
    return body.select(*keys, F.from_json("_b", PAYLOAD).alias("result"))


def _falsy(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def entity_nodes(read: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, pos, id, name, type, props)``: a node for each entity; attributes named id, name or type replace those."""
    e = read.select(*keys, F.posexplode("result.entities").alias("pos", "e"))
    attrs = json_props("e.attributes")
    pick = lambda k, default: F.coalesce(F.when(F.map_contains_key(F.col("_a"), F.lit(k)), F.col("_a")[k]), default)
    out = e.select(*keys, "pos", "e", attrs.alias("_a"))
    rest = F.map_filter("_a", lambda k, v: ~k.isin("id", "name", "type"))
    return out.select(*keys, "pos", pick("id", F.col("e.id")).alias("id"), pick("name", F.col("e.name")).alias("name"), pick("type", F.coalesce("e.type", F.lit(NODE_TYPE))).alias("type"), rest.alias("props"))


def relation_ends(read: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, pos, source, target, relation, evidence, attributes)``: one row for each source and target of each relation.

    A relation without source or target gives no row.
    """
    r = read.select(*keys, F.posexplode("result.relations").alias("pos", "r"))
    r = r.select(*keys, "pos", "r", F.explode(ensure_list("r.source")).alias("source"))
    r = r.select(*keys, "pos", "r", "source", F.explode(ensure_list("r.target")).alias("target"))
    return r.select(*keys, "pos", "source", "target", F.coalesce("r.relation", "r.type", F.lit(EDGE_TYPE)).alias("relation"), F.coalesce("r.evidence", F.lit("")).alias("evidence"), F.col("r.attributes").alias("attributes"))


def _id_names(read: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, id, name)``: of equal ids in one answer the last counts."""
    e = read.select(*keys, F.posexplode("result.entities").alias("_p", "_e")).where("_e.id is not null")
    return e.groupBy(*keys, F.col("_e.id").alias("id")).agg(F.max_by(F.col("_e.name"), F.col("_p")).alias("name"))


def relation_edges(read: DataFrame, keys: list[str]) -> DataFrame:
    """``relation_ends`` with the names of both ends ('' for an id that the answer doesn't define) and the attributes as map ``props``.

    Attributes come last: those named source_name, target_name, relation or evidence replace what else is known.
    """
    ends, names = relation_ends(read, keys), _id_names(read, keys)
    for side in ("source", "target"):
        ends = ends.join(names.select(*keys, F.col("id").alias(side), F.col("name").alias(f"{side}_name")), [*keys, side], "left")
    ends = ends.withColumn("props", json_props("attributes"))
    known = {**{f"{s}_name": F.coalesce(f"{s}_name", F.lit("")) for s in ("source", "target")}, "relation": F.col("relation"), "evidence": F.col("evidence")}
    return ends.withColumns({c: F.when(F.map_contains_key("props", F.lit(c)), F.col("props")[c]).otherwise(v) for c, v in known.items()})


def resolve_triples(read: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, pos, head, relation, tail)`` of relations whose single source and target are known and nothing is blank."""
    r = read.select(*keys, F.posexplode("result.relations").alias("pos", "r")).select(*keys, "pos", "r.source", "r.relation", "r.target")
    names = _id_names(read, keys)
    for side, to in (("source", "head"), ("target", "tail")):
        r = r.join(names.select(*keys, F.col("id").alias(side), F.col("name").alias(to)), [*keys, side])
    return r.where(~_falsy("head") & ~_falsy("relation") & ~_falsy("tail")).select(*keys, "pos", "head", "relation", "tail")


def answer_faults(read: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, fault, pos)``: where answers break the rules that they were asked for.

    ``repeated_id``: an entity whose id an earlier one has; ``no_name``: an entity without name; ``several_targets``: a relation
    whose target is a list or holds a separator; ``no_evidence``: a relation without evidence; ``unknown_end``: a
    relation with an end that no entity has. ``pos`` is the place in ``entities`` or ``relations``.
    """
    e = read.select(*keys, F.posexplode("result.entities").alias("pos", "e"), F.col("result.entities").alias("_all"))
    r = read.select(*keys, F.posexplode("result.relations").alias("pos", "r"), F.coalesce("result.entities", F.array().cast(f"array<{_MEMBER}>")).alias("_all"))
    ids = F.filter(F.transform("_all", lambda x: x["id"]), lambda x: x.isNotNull())
    before = F.transform(F.slice("_all", F.lit(1), F.col("pos")), lambda x: x["id"])
    ends = F.concat(ensure_list("r.source"), ensure_list("r.target"))
    found = lambda df, **rules: df.select(*keys, "pos", F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))).alias("fault"))
    of_entities = found(e, repeated_id=F.array_contains(before, F.col("e.id")), no_name=_falsy("e.name"))
    of_relations = found(r, several_targets=F.coalesce("r.target", F.lit("")).rlike(r"^\[|[,、]"), no_evidence=_falsy("r.evidence"), unknown_end=F.exists(ends, lambda x: ~F.array_contains(ids, x)))
    return of_entities.unionByName(of_relations).select(*keys, "fault", "pos")


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with source, target and evidence."""
    return edges.where(~_falsy("source_name") & ~_falsy("target_name") & ~_falsy("evidence"))


def node_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Merge of two node logs ``(name, id, type, props, seq)``: ``(name, id, type, props)``.

    A node keeps the id and type it was made with; of each property the last value counts, and a null one removes
    it. ``existing`` comes before ``new``, within each ``seq`` decides. Nodes without name are left out.
    """
    log = existing.withColumn("_t", F.lit(0)).unionByName(new.withColumn("_t", F.lit(1))).where("name is not null").withColumn("_o", F.struct("_t", "seq"))
    made = log.groupBy("name").agg(F.min_by(F.struct("id", "type"), "_o").alias("_m"))
    props = log.select("name", "_o", F.explode("props").alias("key", "value"))
    last = props.groupBy("name", "key").agg(F.max_by(F.struct("value"), "_o")["value"].alias("value")).where("value is not null")
    merged = last.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))
    return made.join(merged, "name", "left").select("name", "_m.id", "_m.type", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def edge_load(existing: DataFrame, new: DataFrame, nodes: DataFrame, seq: str) -> DataFrame:
    """Edges of ``new`` to be added: valid, with a relation, both ends in ``nodes``, first of their source, target and evidence, not in ``existing``."""
    keys = ["source_name", "target_name", "evidence"]
    fresh = valid_edges(new).where(~_falsy("relation"))
    first = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_r = 1").drop("_r")
    first = first.join(existing.select(*keys).distinct(), keys, "left_anti")
    known = nodes.select("name").where("name is not null").distinct()
    for side in ("source_name", "target_name"):
        first = first.join(known.withColumnRenamed("name", side), side, "left_semi")
    return first


def current_nodes(log: DataFrame) -> DataFrame:
    """Nodes that are there: of each name in ``log(name, id, type, props, loaded_at, deleted_at)`` the row loaded last, unless it is deleted."""
    last = log.where("name is not null").groupBy("name").agg(F.max_by(F.struct("id", "type", "props", "deleted_at"), F.struct("loaded_at", "id", "type", F.col("deleted_at").isNull())).alias("_l"))
    return last.where("_l.deleted_at is null").select("name", "_l.id", "_l.type", "_l.props")


def evidence_counts(edges: DataFrame) -> DataFrame:
    """``(source_name, target_name, evidence, n)`` of valid edges."""
    return valid_edges(edges).groupBy("source_name", "target_name", "evidence").agg(F.count("*").alias("n"))


def graph_export(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples ``(head, relation, tail, head_props, rel_props, tail_props)`` of edges with both ends; properties as JSON text."""
    def side(name: str, to: str) -> DataFrame:
        return nodes.select(F.col("name").alias(name), F.to_json(F.map_concat(F.create_map(F.lit("id"), "id", F.lit("type"), "type"), F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("id", "type")))).alias(to))

    joined = edges.join(side("source_name", "head_props"), "source_name").join(side("target_name", "tail_props"), "target_name")
    props = F.to_json(F.struct("doc_id", "evidence", "date"))
    return joined.select(F.col("source_name").alias("head"), "relation", F.col("target_name").alias("tail"), "head_props", props.alias("rel_props"), "tail_props")
