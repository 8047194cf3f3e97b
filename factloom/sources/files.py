"""Text documents, triple tables and vectors from files, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import id_from_path, strip_text

TRIPLE = ["head", "relation", "tail"]
PROPS = ["head_props", "rel_props", "tail_props"]


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(doc_id, file_name, text)``: one document per .txt file, without byte-order mark and outer white space.

    Bytes that are not UTF-8 are replaced, not fatal.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(id_from_path("path", "").alias("doc_id"), F.regexp_replace("path", "^.*/", "").alias("file_name"), strip_text(decode_upload("content")).alias("text"))


def decode_upload(content: Column | str) -> Column:
    """Bytes as UTF-8 text without byte-order mark; what isn't UTF-8 is left out, a replacement character that is there stays."""
    c = F.col(content) if isinstance(content, str) else content
    kept = F.replace(c.cast("string"), F.lit("\ufffd"), F.lit("\ufffe"))  # told apart from what make_valid_utf8 puts in
    mended = F.replace(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit("\ufffe"), F.lit("\ufffd"))
    text = F.coalesce(F.try_validate_utf8(c.cast("string")), mended)
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def pending(docs: DataFrame, done: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents without a result yet; a null id is never done."""
    return docs.join(done.select(doc).distinct(), doc, "left_anti")


def resolve_document(docs: DataFrame, name: str, inbox: str) -> DataFrame:
    """The one document meant by ``name`` among ``(path, text)``: that path, else that file of the inbox, else the first such file anywhere."""
    rank = F.when(F.col("path") == name, 0).when(F.col("path") == f"{inbox}/{name}", 1).when(F.col("path").endswith(f"/{name}"), 2)
    return docs.withColumn("_r", rank).where("_r is not null").orderBy("_r", "path").limit(1).drop("_r")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triple CSV with its three optional property columns (null where the file has none); raises if head, relation or tail is missing."""
    have = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    if missing := [c for c in TRIPLE if c not in have]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in have])
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*TRIPLE, *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in PROPS))


def write_triples(df: DataFrame, path: str) -> int:
    """Triple table to CSV that ``read_triples`` reads (empty texts come back as null); returns the number of rows, counted as they are written."""
    seen = Observation()
    df.select(*TRIPLE, *(c for c in PROPS if c in df.columns)).observe(seen, F.count("*").alias("n")).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return seen.get["n"]


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors by row id to Parquet; a run for the same path replaces the last one."""
    df.select("row_id", "embedding").write.mode("overwrite").parquet(path)


def _replace_run(df: DataFrame, path: str, run: str) -> None:
    df.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_reports(df: DataFrame, path: str, run: str) -> None:
    """Reports by document id; a repeated run replaces its own rows and no others."""
    _replace_run(df.select("doc_id", "report"), path, run)


def write_verdicts(df: DataFrame, path: str, run: str) -> None:
    """Verdicts or answers by document id, as ``write_reports``."""
    _replace_run(df.select("doc_id", "round_no", "score", "raw"), path, run)


def write_document_vectors(df: DataFrame, path: str, run: str) -> None:
    """Vectors of whole documents ``(doc_id, vec)``, as ``write_reports``."""
    _replace_run(df.select("doc_id", "vec"), path, run)
