"""Reports: the source text and the numbered knowledge of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings of the two blocks, for news and for questions.
NEWS, QUESTION = ("原始新聞", "比對知識"), ("使用者提問", "知識查詢結果")


def assemble(docs: DataFrame, lines: DataFrame, doc: str, headings: tuple[str, str] = NEWS) -> DataFrame:
    """``(<doc>, report)`` of documents ``(<doc>, text)`` that have lines ``(<doc>, n, text)``: two fenced blocks."""
    listed = lines.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("text").alias("_t")))), lambda x: x["_t"]), "\n").alias("_k"))
    block = lambda h, body: F.concat(F.lit(f"```\n[{h}]\n"), F.col(body), F.lit("\n```"))
    return docs.select(doc, F.col("text").alias("_s")).join(listed, doc).select(doc, F.concat(block(headings[0], "_s"), F.lit("\n"), block(headings[1], "_k")).alias("report"))


#: Bytes of text that a task packs at a time, and that a part of the reports has.
PACKED, PART = 1 << 24, 1 << 25


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each part as one compressed block, in which each text is once."""

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        part = np.asarray(rows.column("part"))
        order, names = np.argsort(part, kind="stable"), [c for c in rows.column_names if c != "part"]
        each, start = np.unique(part[order], return_index=True)
        out = []
        for a, b in zip(start, [*start[1:], len(order)]):
            mine = rows.select(names).take(pa.array(order[a:b]))
            mine = mine.set_column(names.index("text"), "text", mine.column("text").combine_chunks().dictionary_encode())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, mine.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(mine)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array(out, pa.binary())], ["part", "block"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > PACKED:
            yield blocks(held)
            held, size = [], 0
    if held:
        yield blocks(held)


def packed_reports(docs: DataFrame, lines: DataFrame, doc: str, n_parts: int, headings: tuple[str, str] = NEWS) -> DataFrame:
    """``assemble`` for documents ``(d, <doc>, text)`` and lines ``(d, n, numbered, text)``; a line that is ``numbered`` gets ``[n]`` before it.

    Texts cross the shuffle in compressed blocks by part, and reports are made where they arrive. Every document must have lines.
    """
    part = F.pmod(F.xxhash64("d"), F.lit(n_parts)).cast("int").alias("part")
    of_doc = docs.select(part, "d", F.lit(0).alias("n"), F.lit(False).alias("numbered"), "text", F.col(doc).alias("of"))
    rows = lines.select(part, "d", F.col("n").cast("int").alias("n"), "numbered", "text", F.lit(None).cast(docs.schema[doc].dataType).alias("of")).unionByName(of_doc)
    blocks = rows.mapInArrow(_packed, "part int, block binary").repartition(n_parts, "part").sortWithinPartitions("part")
    above, below = (f"```\n[{h}]\n" for h in headings)

    def reports(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        d, n, numbered, text, of = [], [], [], [], []
        for block in held:
            got = pa.ipc.open_stream(block).read_all().combine_chunks()
            words = got.column("text").combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            known = [*words.dictionary.to_pylist(), None]
            text += [known[i] for i in words.indices.fill_null(len(known) - 1).to_pylist()]
            d.append(np.asarray(got.column("d")))
            n.append(np.asarray(got.column("n")))
            numbered += got.column("numbered").to_pylist()
            of.append(got.column("of"))
        d, n, of = np.concatenate(d), np.concatenate(n), pa.chunked_array([c for x in of for c in x.chunks]).combine_chunks()
        order = np.lexsort((n, d))
        first = np.flatnonzero(np.r_[True, np.diff(d[order]) != 0])
        at, said = [], []
        for a, b in zip(first, [*first[1:], len(order)]):
            mine = order[a:b].tolist()
            k = int(np.searchsorted(n[order[a:b]], 1))  # a document may have several texts
            known = "\n".join(f"[{n[i]}]{text[i]}" if numbered[i] else text[i] for i in mine[k:])
            for i in mine[:k]:
                at.append(i)
                said.append(None if text[i] is None else f"{above}{text[i]}\n```\n{below}{known}\n```")
        of = of.take(pa.array(at, pa.int64()))
        for a in range(0, len(at), 1000):
            yield pa.RecordBatch.from_arrays([of[a : a + 1000], pa.array(said[a : a + 1000], pa.string())], [doc, "report"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part_, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if part_ != now and held:
                    yield from reports(held)
                    held = []
                now = part_
                held.append(block)
        if held:
            yield from reports(held)

    return blocks.mapInArrow(run, T.StructType([docs.schema[doc], T.StructField("report", T.StringType())]))


def status(docs: DataFrame, triples: DataFrame, hits: DataFrame, doc: str) -> DataFrame:
    """``(<doc>, status)``: NO_TRIPLES, NO_HITS or OK for each document, instead of ending a batch."""
    t, h = triples.select(doc).distinct().withColumn("_t", F.lit(True)), hits.select(doc).distinct().withColumn("_h", F.lit(True))
    joined = docs.select(doc).distinct().join(t, doc, "left").join(h, doc, "left")
    return joined.select(doc, F.when(F.col("_t").isNull(), "NO_TRIPLES").when(F.col("_h").isNull(), "NO_HITS").otherwise("OK").alias("status"))
