"""Mixtures of sources by hierarchical budgets over tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the hash range in which a source's sizes are summed before any order is made.
RANGES = 4096


def budgets(leaves: list[dict], total: float) -> dict[str, float]:
    """Tokens of each leaf. ``leaves``: ``path`` (tuple from the root down), ``weight``, ``capacity``.

    Each node passes its budget to its children by weight. What a child cannot hold goes to its siblings by
    their weights as long as they have room; only what the whole family cannot hold goes up to the ancestors'
    other children. What no leaf can hold is left over.
    """

    def give(group: list[dict], depth: int, budget: float) -> dict[str, float]:
        if not group:
            return {}
        if all(len(x["path"]) == depth for x in group):
            leaf = group[0]
            return {leaf["name"]: min(budget, leaf["capacity"])}
        families: dict[str, list[dict]] = {}
        for x in group:
            families.setdefault(x["path"][depth], []).append(x)
        room = {k: sum(x["capacity"] for x in v) for k, v in families.items()}
        weight = {k: sum(x["weight"] for x in v) for k, v in families.items()}
        share = dict.fromkeys(families, 0.0)
        open_, left = {k for k in families if weight[k] > 0}, budget
        while open_ and left > 0:
            whole = sum(weight[k] for k in open_)
            full = {k for k in open_ if share[k] + left * weight[k] / whole >= room[k]}
            if not full:
                for k in open_:
                    share[k] += left * weight[k] / whole
                break
            for k in full:
                left -= room[k] - share[k]
                share[k] = room[k]
            open_ -= full
        return {name: n for k, v in families.items() for name, n in give(v, depth + 1, share[k]).items()}

    return give(leaves, 0, total)


def plan(sizes: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens", total: float | None = None, levels: list[str] | None = None) -> DataFrame:
    """One row per source of ``targets``: ``(source, target_share, max_repeats, tokens, capacity, wanted, reachable, budget)``.

    ``targets`` is the table of the mixture's sources (``source``, ``target_share``, ``max_repeats``, and the
    columns named in ``levels`` for domain, language, ...); it is configuration, and the only thing collected.
    ``total`` is the mixture's size in tokens, by default that of all documents of these sources, each once. A
    source is reachable if, of all those tokens, its budget does not end at its capacity (tokens times
    ``max_repeats``) before its share is met. Null and unknown sources are outside the mixture; a source without
    documents has no tokens.
    """
    held = sizes.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("tokens"))
    wanted = targets.where("source is not null").dropDuplicates(["source"])
    rows = wanted.join(held, "source", "left").fillna(0, ["tokens"]).collect()
    everything = sum(r["tokens"] for r in rows)
    goal = float(everything if total is None else total)
    leaves = [{"name": r["source"], "path": (*(r[c] for c in levels or []), r["source"]), "weight": r["target_share"] or 0.0, "capacity": r["tokens"] * (r["max_repeats"] or 0)} for r in rows]
    got, due = budgets(leaves, goal), budgets(leaves, float(everything))
    short = {x["name"] for x in leaves if due.get(x["name"], 0.0) >= x["capacity"] and x["capacity"] < x["weight"] * everything}
    out = [(r["source"], r["target_share"], r["max_repeats"], r["tokens"], x["capacity"], (r["target_share"] or 0.0) * goal, r["source"] not in short, float(got.get(r["source"], 0.0))) for r, x in zip(rows, leaves)]
    return sizes.sparkSession.createDataFrame(out, "source string, target_share double, max_repeats int, tokens bigint, capacity bigint, wanted double, reachable boolean, budget double")


def by_levels(sizes: DataFrame, targets: DataFrame, levels: list[str], source: str = "source", size: str = "n_tokens") -> tuple[DataFrame, DataFrame]:
    """``sizes`` and ``targets`` for a tree whose leaves are a source's documents of one value of each of ``levels``.

    ``source`` becomes the leaf's path as text; its target is the source's, in proportion to its part of the source's
    tokens. Null levels are a value of their own. Leaves are as many as sources times values of the levels.
    """
    path = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*levels, source)))
    leaf = sizes.withColumn("_leaf", path)
    held = leaf.groupBy("_leaf", *levels, F.col(source).alias("_source")).agg(F.sum(size).alias("_n"))
    whole = held.groupBy("_source").agg(F.sum("_n").alias("_all"))
    wanted = targets.select(F.col("source").alias("_source"), "target_share", "max_repeats").dropDuplicates(["_source"])
    out = held.join(whole, "_source").join(wanted, "_source").where("_all > 0")
    return leaf.drop(source).withColumnRenamed("_leaf", source), out.select(F.col("_leaf").alias("source"), (F.col("target_share") * F.col("_n") / F.col("_all")).alias("target_share"), "max_repeats", *levels)


def mix(sizes: DataFrame, planned: DataFrame, doc_id: str, source: str = "source", size: str = "n_tokens", seed: int = 7) -> DataFrame:
    """The mixture: ``(<doc_id>, source, n_tokens, epoch)``, a row per use of a document.

    A source's budget pays for whole epochs first; of the last one, the documents come in a seeded order that
    differs by epoch, and the longest prefix within the budget is taken. The order is made in ranges of the
    hash: sums by range tell which range holds the end of the prefix, so only one range per source is sorted.
    """
    docs = sizes.select(F.col(doc_id).alias(doc_id), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens"))
    terms = planned.where("budget > 0 and tokens > 0").select("source", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("_full"), "budget", "tokens")
    terms = terms.select("source", "_full", (F.col("budget") - F.col("_full") * F.col("tokens")).alias("_rest"))
    mine = docs.join(F.broadcast(terms), "source")  # as many rows as the mixture has sources
    whole = mine.where("_full > 0").select(doc_id, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_full"))).alias("epoch"))
    order = mine.where("_rest > 0").withColumn("_h", F.xxhash64(F.col(doc_id), F.lit(seed), F.col("_full"))).withColumn("_range", F.pmod(F.shiftright("_h", 20), F.lit(RANGES)))
    sums = order.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range"))
    ends = sums.withColumn("_to", upto).select("source", "_range", (F.col("_to") - F.col("_sum")).alias("_from"), "_to")
    ranged = order.join(ends, ["source", "_range"])
    inside = ranged.where("_to <= _rest")
    edge = ranged.where("_to > _rest and _from <= _rest")
    running = F.col("_from") + F.sum("n_tokens").over(Window.partitionBy("source", "_range").orderBy("_h", doc_id).rowsBetween(Window.unboundedPreceding, 0))
    part = inside.unionByName(edge.withColumn("_run", running).where("_run <= _rest").drop("_run"))
    return whole.unionByName(part.select(doc_id, "source", "n_tokens", (F.col("_full") + 1).alias("epoch")))


def shares(mixture: DataFrame, planned: DataFrame) -> DataFrame:
    """Actual against target shares: ``(source, target_share, actual_share, tokens_used, uses, epochs)``."""
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("uses"), F.max("epoch").alias("epochs"))
    every = planned.select("source", "target_share").join(used, "source", "left").fillna(0, ["tokens_used", "uses", "epochs"])
    total = used.agg(F.sum("tokens_used").alias("_all"))
    return every.join(F.broadcast(total)).select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens_used"), F.col("_all")), F.lit(0.0)).alias("actual_share"), "tokens_used", "uses", "epochs")
