"""Token ids of a whole corpus through a table of its distinct words."""

from __future__ import annotations

import base64
import itertools
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import written

#: Folder of the public tokenizers' vocabulary files; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"
#: Words of a bundle of documents (more only if one text has more), bytes of the corpus per part of the table of words, and words in one numpy step.
BUNDLE, PART, STEP = 1 << 19, 1 << 26, 1 << 16
# The split pattern of the byte-level vocabularies, and letters newer than the JVM's tables.
_NEWER = r"\x{31350}-\x{323AF}\x{2EBF0}-\x{2EE5D}\x{1DF00}-\x{1DF1E}\x{9FFD}-\x{9FFF}\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B739}"
PATTERN = rf"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}{_NEWER}]+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}{_NEWER}]+|\s+(?!\S)|\s+"


def ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The vocabulary of a rank file, piece to id."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def words(text: Column) -> Column:
    """The words of a text, in order; together they are the whole text. Null gives null, empty none."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _encoder(held: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=held, special_tokens={})


def encode_corpus(docs: DataFrame, doc_id: str, text: str, name: str, folder: str = TOKENIZERS) -> DataFrame:
    """``(<doc_id>, ids array<int>)``, a row for every row of ``docs``; null and empty texts give the empty list.

    By a table of distinct words that is spread over tasks by word, so that each word of the corpus is encoded once.
    The JVM splits the texts. The documents of a map task are taken together in bundles of BUNDLE words; a bundle
    keeps its documents as places in its own list of distinct words, and sends that list, cut by part of the table, to
    where the words are encoded. What comes back are the ids of the list, which the places put in order. A frequent
    word is sent once per bundle. Bundles are a written table, so a lost executor changes none of them. Other
    columns are not read.
    """
    bundles, parts = word_lists(docs, [doc_id], text)
    return _finished(bundles, encoded_lists(bundles, parts, name, folder), [doc_id], "ids array<int>", _ids)


def count_tokens(docs: DataFrame, keys: list[str], text: str, name: str, folder: str = TOKENIZERS) -> DataFrame:
    """``(<keys>, n_tokens bigint)``, a row for every row of ``docs``, by the same table; only the words' lengths come back."""
    bundles, parts = word_lists(docs, keys, text)
    return _finished(bundles, encoded_lists(bundles, parts, name, folder, False), keys, "n_tokens bigint", _sizes)


def word_lists(docs: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, int]:
    """Bundles ``(bundle, part, docs, counts, data)`` and the number of parts of the table of words.

    Part -1 is a bundle's documents, their numbers of words, and the words' places; the others are its distinct
    words of that part. A part's words are at most PART bytes of the corpus, or one of as many as there are cores.
    """
    row = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("doc")
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART))
    split = docs.select(row, words(F.col(text)).alias("words"))
    doc = split.schema["doc"].dataType.simpleString()
    return written(split.mapInArrow(_bundle(parts), f"bundle string, part int, docs array<{doc}>, counts binary, data binary"), "bundles"), parts


def encoded_lists(bundles: DataFrame, parts: int, name: str, folder: str = TOKENIZERS, ids: bool = True) -> DataFrame:
    """``(bundle, part, data, fresh)``: the ids of each list of words, or only their numbers; ``fresh`` of them were encoded for it."""
    lists = bundles.where("part >= 0").select("bundle", "part", "data").repartitionById(parts, "part")
    held = bundles.sparkSession.sparkContext.broadcast(ranks(name, folder))  # of the vocabulary's size; only the driver reads the folder
    return lists.mapInArrow(_encode_part(held, ids), "bundle string, part int, data binary, fresh bigint")


def _finished(bundles: DataFrame, encoded: DataFrame, keys: list[str], added: str, finish) -> DataFrame:
    every = bundles.where("part < 0").unionByName(encoded.drop("fresh"), allowMissingColumns=True)
    doc = bundles.schema["docs"].dataType.elementType.simpleString()
    out = every.groupBy("bundle").applyInArrow(finish, f"doc {doc}, {added}")
    return out.select(*(F.col(f"doc.k{i}").alias(k) for i, k in enumerate(keys)), added.split()[0])


def _pressed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers as one compressed block, each by planes of bytes of equal weight; led by its size and the first one's."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
    return np.array([len(raw), len(columns[0])], "<u8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _opened(block: bytes) -> tuple[int, np.ndarray]:
    size, n = (int(x) for x in np.frombuffer(block[:16], "<u8"))
    return n, np.frombuffer(pa.decompress(block[16:], size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)


def _numbers(raw: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _bundle(parts: int):
    """Arrow function over split documents: the rows of their bundles."""

    def rows(docs: pa.Array, lists: pa.Array):
        kind, bundle = pa.list_(docs.type), uuid.uuid4().hex
        word = pc.list_flatten(lists).cast(pa.large_string()).dictionary_encode()
        at, distinct = np.asarray(word.indices), word.dictionary
        part = np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in distinct.to_pylist()), np.int64, len(distinct))
        order = np.lexsort((-np.bincount(at, minlength=len(distinct)), part))  # frequent words first: small places
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        record = lambda n, docs, counts, data: pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([n], pa.int32()), docs, pa.array([counts], pa.binary()), pa.array([data], pa.binary())], ["bundle", "part", "docs", "counts", "data"])
        yield record(-1, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), _pressed(_lengths(lists).astype("<u4")), _pressed(place[at]))
        text, part = distinct.take(pa.array(order)), part[order]
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        ends = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else None
        for a, b in zip(edges, np.append(edges[1:], len(part))):
            held = np.frombuffer(text.buffers()[2], np.uint8)[ends[a] : ends[b]]
            yield record(int(part[a]), pa.array([None], kind), None, _pressed(np.diff(ends[a : b + 1]).astype("<u4"), held))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            docs, lists = batch.column("doc"), batch.column("words")
            to, at = np.cumsum(_lengths(lists)), 0
            while at < len(lists):
                done = int(to[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(to, done + BUNDLE - n, "right")))
                held.append((docs.slice(at, end - at), lists.slice(at, end - at)))
                n, at = n + int(to[end - 1]) - done, end
                if n >= BUNDLE or at < len(lists):
                    yield from rows(*(pa.concat_arrays([h[i] for h in held]) for i in (0, 1)))
                    held, n = [], 0
        if held:
            yield from rows(*(pa.concat_arrays([h[i] for h in held]) for i in (0, 1)))

    return run


def _encode_part(held, ids: bool):
    """Arrow function over the lists of one part: each of its distinct words is encoded once."""

    def run(batches):
        rows = [(*r, _opened(block)) for batch in batches for *r, block in zip(*(batch.column(c).to_pylist() for c in ("bundle", "part", "data")))]
        if not rows:
            return
        count = np.array([n for *_, (n, _) in rows])
        size = np.concatenate([_numbers(raw[: 4 * n], "<u4") for *_, (n, raw) in rows])
        data = np.concatenate([raw[4 * n :] for *_, (n, raw) in rows])
        word = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size, dtype=np.int64))), pa.py_buffer(data)]).dictionary_encode()
        encoder, at = _encoder(held.value), np.asarray(word.indices)
        sizes, flat = [], []
        for a in range(0, len(word.dictionary), STEP):
            got = [encoder.encode_ordinary(w) for w in word.dictionary.slice(a, STEP).to_pylist()]
            sizes.append(np.fromiter(map(len, got), "<u4", len(got)))
            flat.append(np.fromiter(itertools.chain.from_iterable(got), "<u2", int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(flat)
        start = np.cumsum(size, dtype=np.int64) - size
        ends = np.cumsum(count)
        first = np.bincount(np.searchsorted(ends, np.unique(at, return_index=True)[1], "right"), minlength=len(rows))
        for (bundle, part, _), a, b, fresh in zip(rows, ends - count, ends, first):
            mine = at[a:b]
            block = _pressed(size[mine], _spread(flat, start[mine], size[mine])) if ids else _pressed(size[mine])
            yield pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([part], pa.int32()), pa.array([block], pa.binary()), pa.array([int(fresh)])], ["bundle", "part", "data", "fresh"])

    return run


def _spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``start``, one after the other."""
    size = size.astype(np.int64)
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _placed(bundle: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bundle's documents, where their words end, the words' places in its list, and the list's sizes and ids."""
    order = np.argsort(np.asarray(bundle.column("part")))
    own = int(order[0])
    docs = bundle.column("docs")[own].values
    ends = np.cumsum(_numbers(_opened(bundle.column("counts")[own].as_py())[1], "<u4"), dtype=np.int64)
    place = _numbers(_opened(bundle.column("data")[own].as_py())[1], "<u4")
    lists = [_opened(bundle.column("data")[int(i)].as_py()) for i in order[1:]]
    size = np.concatenate([np.zeros(0, "<u4"), *(_numbers(raw[: 4 * n], "<u4") for n, raw in lists)])
    return docs, ends, place, size, np.concatenate([np.zeros(0, "<u2"), *(_numbers(raw[4 * n :], "<u2") for n, raw in lists)])


def _ids(bundle: pa.Table) -> pa.Table:
    docs, ends, place, size, flat = _placed(bundle)
    start = np.cumsum(size, dtype=np.int64) - size
    found = [_spread(flat, start[p], size[p]).astype(np.int32) for p in np.array_split(place, 1 + len(place) // STEP)]
    to = np.append(0, np.cumsum(size[place], dtype=np.int64))[np.append(0, ends)]
    return pa.table([docs, pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(np.concatenate(found)))], ["doc", "ids"])


def _sizes(bundle: pa.Table) -> pa.Table:
    docs, ends, place, size, _ = _placed(bundle)
    to = np.append(0, np.cumsum(size[place], dtype=np.int64))[np.append(0, ends)]
    return pa.table([docs, pa.array(np.diff(to))], ["doc", "n_tokens"])


def decode_corpus(encoded: DataFrame, doc_id: str, ids: str, name: str, folder: str = TOKENIZERS) -> DataFrame:
    """``(<doc_id>, text)``, a row for every row of ``encoded``: lists of ids joined with the id-to-piece table; an empty and a null list give ''.

    The table has the vocabulary's size and is broadcast; a batch is joined at once, where it is, and its pieces are then the
    texts already, end to end. Ids that are not in the vocabulary give nothing.
    """
    piece = ranks(name, folder)
    by_id = sorted(piece.items(), key=lambda x: x[1])
    held = encoded.sparkSession.sparkContext.broadcast(([b for b, _ in by_id], np.array([i for _, i in by_id], np.int64)))

    def join(lists: pa.Array) -> pa.Array:
        pieces, known = held.value
        flat = np.asarray(pc.fill_null(pc.list_flatten(lists), -1)).astype(np.int64)
        at = np.searchsorted(known, flat)
        found = known[np.minimum(at, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
        texts = pa.array([*pieces, b""], pa.large_binary()).take(pa.array(np.where(found, at, len(pieces))))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        to = np.append(0, np.cumsum(_lengths(lists)))
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends[to] - ends[0]).astype(np.int32)), texts.buffers()[2] if len(texts) else pa.py_buffer(b"")])

    return encoded.select(F.col(doc_id).alias(doc_id), F.make_valid_utf8(F.arrow_udf(join, "binary")(F.col(ids)).cast("string")).alias("text"))
