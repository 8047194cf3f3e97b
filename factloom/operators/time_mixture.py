"""Times written in many forms to UTC instants, the form chosen by a mixture model per source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import time_text as tt

MAX_ROUNDS, CLOSE, SURE = 200, 1e-9, 0.9
#: How much less likely a text in another order than the declared one is than one in it, and than one that is broken.
UNDECLARED, BROKEN = 1e-3, 1e-2


def fit_mixture(counts: pd.DataFrame) -> pd.DataFrame:
    """Expectation-maximisation over one source's formats.

    ``counts`` has one row per signature (the array of formats under which a value parses) and declared order, with its
    number of values. A value's likelihood is equal under each format that parses it and nil under the others; a
    format in another order than the declared one has UNDECLARED of it, and a value without any reading in the declared
    order may also be broken (BROKEN of it). The E-step shares a signature's count by the formats' weights and these
    priors, the M-step sums the shares; every format starts equal and keeps one pseudo-count. Returns the best
    format of each signature (null: broken) and its posterior.
    """
    formats = sorted({f for s in counts["signature"] for f in s}) + [None]
    at = {f: i for i, f in enumerate(formats)}
    prior = np.zeros((len(counts), len(formats)))
    for i, (s, order) in enumerate(zip(counts["signature"], counts["order"])):
        other = [order is not None and f.split("_")[0] in tt.ORDERS and f.split("_")[0] != order for f in s]
        prior[i, [at[f] for f in s]] = [UNDECLARED if x else 1 for x in other]
        prior[i, -1] = BROKEN if all(other) else 0
    n = counts["n"].to_numpy(float)[:, None]
    weight = np.full(len(formats), 1 / len(formats))
    share = prior
    for _ in range(MAX_ROUNDS):
        share = prior * weight
        share /= share.sum(1, keepdims=True)
        new = (share * n).sum(0) + 1
        new /= new.sum()
        moved, weight = np.abs(new - weight).max(), new
        if moved < CLOSE:
            break
    best = share.argmax(1)
    return pd.DataFrame({"source": counts["source"], "signature": counts["signature"], "order": counts["order"], "fmt": [formats[b] for b in best], "posterior": share.max(1)})


def normalise_times(df: DataFrame, date: str, time: str | None, source: str, zone: str, order: str, first: str, last: str) -> DataFrame:
    """Adds ``instant`` (UTC, TIMESTAMP_NTZ), ``time_format``, ``posterior`` and ``time_status`` to ``df``.

    ``date`` and ``time`` are text columns: with both present they are day and time of day, else the one present
    is the whole. ``zone`` is the local zone of texts that state none, ``order`` the declared order of all-number
    dates, a prior of the mixture fitted per ``source`` over all rows (null: unknown, left to the data). Readings
    outside the dates ``first`` to ``last`` are impossible.

    ``time_status``: ``ok``; ``none`` (null or blank); ``unread`` (no possible reading, none in the declared order, or local time
    without a known zone); ``ambiguous`` (no format reaches a posterior of 0.9: ``instant`` stays null). Null sources form
    one source of their own. Only signature counts cross the shuffle, one small group per source; a source's
    share of the rows does not matter. Columns named like the added ones are replaced.
    """
    added = ["instant", "time_format", "posterior", "time_status"]
    said = F.col(time) if time else F.lit(None).cast("string")
    base = df.drop(*added).withColumn("_parsed", tt.parser(first, last)(F.col(date), said))
    base = base.withColumn("_signature", F.array_sort(F.array_distinct(F.col("_parsed.readings.fmt"))))
    base = base.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("_order", F.coalesce(F.col(order), F.lit("")))
    counts = base.where(F.size("_signature") > 0).groupBy(F.col("_source").alias("source"), F.col("_signature").alias("signature"), F.nullif("_order", F.lit("")).alias("order")).agg(F.count("*").alias("n"))
    chosen = counts.groupBy("source").applyInPandas(fit_mixture, "source string, signature array<string>, order string, fmt string, posterior double")
    chosen = chosen.select(F.col("source").alias("_source"), F.col("signature").alias("_signature"), F.coalesce("order", F.lit("")).alias("_order"), F.col("fmt").alias("_fmt"), F.col("posterior").alias("_posterior"))
    out = base.join(chosen, ["_source", "_signature", "_order"], "left")
    parsed = F.col("_parsed")
    read = F.get(F.filter(parsed["readings"], lambda x: x["fmt"] == F.col("_fmt")), 0)
    same = F.size(F.array_distinct(F.transform(parsed["readings"], lambda x: F.struct(x["day"], x["epoch"])))) == 1
    sure = (F.col("_posterior") >= SURE) | (same & F.col("_fmt").isNotNull())
    out = out.withColumn("instant", F.when(sure, tt.instant(read["day"], read["epoch"], parsed, F.col(zone))))
    out = out.withColumn("time_format", F.col("_fmt")).withColumn("posterior", F.col("_posterior"))
    status = F.when(~parsed["said"], "none").when((F.size("_signature") > 0) & ~sure, "ambiguous").when(F.col("instant").isNull(), "unread").otherwise("ok")
    return out.withColumn("time_status", status).select(*(c for c in df.columns if c not in added), *added)
