"""Verdicts of a language model read back: labelled points, cited knowledge, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import clean_json_fence, split_lines

# Signs that head the three kinds of points.
AGREES, CONTRADICTS, MISSING = "✅", "❌", "⚠"
LABELS = {AGREES: "consistent", CONTRADICTS: "contradictory", MISSING: "missing"}
# A score, a numbered point, the heading of another section.
_SCORE, _POINT, _SECTION = r"(?<![\d.])(\d{1,2})\s*(?:分|/\s*10)", r"^\s*\d+\.\s*(.*\S)", r"^\s*[一二三四五六七八九十]、"


def score(raw: Column | str) -> Column:
    """The last score from 1 to 10 in a verdict; null if it gives none."""
    said = F.transform(F.regexp_extract_all(raw, F.lit(_SCORE), F.lit(1)), lambda x: x.cast("int"))
    return F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.filter(said, lambda x: (x >= 1) & (x <= 10))), -1)


def cited(text: Column | str, most: Column | str) -> Column:
    """Distinct numbers in square brackets, from 1 to ``most``, in order; those beyond cite nothing. A null ``most`` allows all."""
    limit = F.col(most) if isinstance(most, str) else most
    said = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(said, lambda x: (x >= 1) & (limit.isNull() | (x <= limit)))))


def knowledge_lines(report: Column | str) -> Column:
    """How many knowledge lines a report numbers."""
    return F.size(F.regexp_extract_all(report, F.lit(r"(?m)^(\[\d+\])"), F.lit(1)))


def points(verdicts: DataFrame, keys: list[str], raw: str, most: str) -> DataFrame:
    """``(<keys>, label, item_no, text, cited)``: the numbered points under each sign, numbered in each verdict from 1.

    A code fence round the verdict is taken off. Points before the first sign or after the heading of another section
    are none; a verdict without any gives no row.
    """
    line = verdicts.select(*keys, F.col(most).alias("_most"), F.posexplode(split_lines(clean_json_fence(raw))).alias("_i", "_line"))
    sign = F.coalesce(*(F.when(F.ltrim("_line").startswith(s), F.lit(name)) for s, name in LABELS.items()), F.when(F.col("_line").rlike(_SECTION), F.lit("")))
    within = Window.partitionBy(*keys).orderBy("_i")
    labelled = line.withColumn("label", F.last(sign, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    found = labelled.where(sign.isNull() & F.col("_line").rlike(_POINT)).where("label <> ''")
    return found.select(*keys, "label", F.row_number().over(within).alias("item_no"), F.regexp_extract("_line", _POINT, 1).alias("text"), cited("_line", "_most").alias("cited"))
