"""References to records that are not there: orphan detection by distributed anti-joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.json_arrow import nodes, slices
from factloom.session import written

_BLANK = r"(?U)^\s*$"


def orphan_keys(refs: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-null ``keys`` of ``refs`` without a row in ``parents``.

    Both sides are made distinct before they meet, so a hot key crosses the shuffle once per map task. A key
    with a null part is no reference and is left out. Empty parents: every key is an orphan.
    """
    known = refs.select(*keys).dropna().distinct()
    return known.join(parents.select(*keys).dropna().distinct(), keys, "left_anti")


def timed_orphans(refs: DataFrame, parents: DataFrame, ref: str, at: str, name: str, begins: str, ends: str) -> DataFrame:
    """Rows of ``refs`` whose ``ref`` names no record of ``parents`` that exists at time ``at``; adds ``reason``.

    ``missing``: no parent of that name at all. ``late``: all such parents begin after ``at``. ``deleted``: one
    had begun, and none of those was still there (``ends`` not after ``at``). Null and blank references are no
    references; a null ``begins`` counts as always there, a null ``ends`` as never deleted, a null ``at`` as the
    end of time. Names repeated with other times are all taken into account; repeated rows count once.
    """
    clean = refs.where(F.col(ref).isNotNull() & ~F.col(ref).rlike(_BLANK)).dropDuplicates()
    span = parents.where(F.col(name).isNotNull()).select(F.col(name).alias("_name"), F.col(begins).alias("_from"), F.col(ends).alias("_to")).distinct()
    one = span.groupBy("_name").agg(F.count("*").alias("_n"), F.first("_from").alias("_from"), F.first("_to").alias("_to"))
    gone = orphan_keys(clean.select(F.col(ref).alias("_name")), parents.select(F.col(name).alias("_name")), ["_name"])
    missing = clean.join(gone, clean[ref] == gone["_name"], "left_semi").withColumn("reason", F.lit("missing"))

    begun = F.col("_from").isNull() | F.col(at).isNull() | (F.col("_from") <= F.col(at))
    over = F.col("_to").isNotNull() & (F.col(at).isNull() | (F.col("_to") <= F.col(at)))
    state = F.when(~begun, "late").when(over, "deleted")
    joined = clean.join(one, clean[ref] == one["_name"])
    single = joined.where((F.col("_n") == 1) & state.isNotNull()).withColumn("reason", state).drop(*one.columns)
    # names with several spans: the best state over all of them ('alive' beats 'deleted' beats 'late')
    several = span.join(one.where("_n > 1").select("_name"), "_name", "left_semi")
    best = F.max(F.when(~begun, 0).when(over, 1).otherwise(2))
    many = clean.join(several, clean[ref] == several["_name"]).groupBy(*clean.columns).agg(best.alias("_best")).where("_best < 2")
    many = many.withColumn("reason", F.when(F.col("_best") == 0, "late").otherwise("deleted")).drop("_best")
    return missing.unionByName(single).unionByName(many)


def payload_references(df: DataFrame, carried: list[str], payload: str) -> DataFrame:
    """Ids that the payloads define and ids that they refer to: ``(<carried>, pos, field, ref)``.

    ``field`` is null for a defined id (entities[].id), else ``source`` or ``target`` of ``relations[pos]``.
    Ids are upper case without outer white space; one text may hold several, separated by ``,`` or ``、``;
    blank is none. Only readable payloads count.
    """
    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField("pos", T.LongType()), T.StructField("field", T.StringType()), T.StructField("ref", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, payload):
                x = nodes(piece.column(payload), lenient=True)
                scalar = np.flatnonzero(x.is_scalar() & ((x.depth == 3) | ((x.depth == 4) & (x.pos >= 0))))
                member = np.where(x.depth[scalar] == 4, x.parent[scalar], scalar)
                element = x.parent[member]
                array = x.parent[element]
                key = x.key.take(pa.array(member))
                top = x.key.take(pa.array(array))
                said = lambda col, *names: np.asarray(pc.fill_null(pc.is_in(col, pa.array(names, pa.large_string())), False))
                inner = x.pos[element] >= 0
                own = said(top, "entities") & said(key, "id") & (x.depth[scalar] == 3) & inner
                ref = said(top, "relations") & said(key, "source", "target") & inner
                text = x.text(scalar)
                null = ~x.is_string()[scalar] & np.asarray(pc.equal(text, pa.scalar("null", pa.large_string())))
                use = (own | ref) & ~null
                parts = pc.split_pattern_regex(text.filter(pa.array(use & ref)).cast(pa.string()), "[,、]")
                up = np.asarray(pc.list_parent_indices(parts))
                at = np.concatenate([np.flatnonzero(use & own), np.flatnonzero(use & ref)[up]])
                ids = pa.concat_arrays([text.filter(pa.array(use & own)).cast(pa.string()), pc.list_flatten(parts)])
                ids = pc.utf8_upper(pc.utf8_trim_whitespace(ids))
                full = np.asarray(pc.not_equal(ids, ""))
                at, ids = at[full], ids.filter(pa.array(full))
                is_ref = ref[at]
                pos = pa.array(x.pos[element[at]], mask=~is_ref)
                field = pc.if_else(pa.array(is_ref), key.take(pa.array(at)).cast(pa.string()), pa.scalar(None, pa.string()))
                row = pa.array(x.row[scalar[at]])
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(row) for c in carried), pos, field, ids], schema.names)

    return df.select(*dict.fromkeys([*carried, payload])).mapInArrow(run, schema)


def payload_orphans(results: DataFrame) -> DataFrame:
    """Orphan ids inside extraction payloads: ``(extraction_id, doc_id, loaded_at, pos, field, ref, reason)``.

    ``late`` if a readable payload of a later round of the same document defines the id, else ``missing``.
    The payloads are read once, into a table of references in the shared folder; an answer without doc_id has no
    later round.
    """
    found = payload_references(results, ["extraction_id", "doc_id", "round_no", "loaded_at"], "payload")
    found = written(found, "references")
    defined = found.where("field is null")
    refs = found.where("field is not null")
    keys = ["extraction_id", "ref"]
    gone = refs.join(orphan_keys(refs, defined, keys), keys, "left_semi")
    latest = defined.where("doc_id is not null").groupBy("doc_id", "ref").agg(F.max("round_no").alias("_last"))
    gone = gone.join(latest, ["doc_id", "ref"], "left")
    reason = F.when(F.col("_last") > F.col("round_no"), "late").otherwise("missing")
    return gone.select("extraction_id", "doc_id", "loaded_at", "pos", "field", "ref", reason.alias("reason")).distinct()


def edge_orphans(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edge ends that name no entity there at the edge's time: ``(edge_id, loaded_at, field, ref, reason)``."""
    ends = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("ref")) for c in ("source_name", "target_name"))))
    refs = edges.select("edge_id", "loaded_at", ends.alias("_end")).select("edge_id", "loaded_at", "_end.field", "_end.ref")
    return timed_orphans(refs, entities, "ref", "loaded_at", "name", "loaded_at", "deleted_at")


def orphan_report(orphans: DataFrame, tbl: str) -> DataFrame:
    """Number of orphan references per month of ``loaded_at``, field and reason."""
    return orphans.groupBy(F.lit(tbl).alias("tbl"), F.date_format("loaded_at", "yyyy-MM").alias("month"), "field", "reason").agg(F.count("*").alias("n"))
