"""The inbox folder as a stream: new files are handled once, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.functions.text import id_from_path, strip_text


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Stream ``(doc_id, text)``: one row for each .txt file that arrives."""
    files = spark.readStream.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(id_from_path("_metadata.file_name", "").alias("doc_id"), strip_text("value").alias("text"))


def drain(inbox: DataFrame, checkpoint: str, handle: Callable[[DataFrame], DataFrame], out: str):
    """Run ``handle`` over all that has arrived and not been handled, write its rows to Parquet, stop. Returns the finished query.

    Each micro-batch has a folder of its own that a repeated attempt replaces, so no row is there twice.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        handle(df.dropDuplicates(["doc_id"])).write.mode("overwrite").parquet(f"{out}/_epoch={epoch}")

    query = inbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
