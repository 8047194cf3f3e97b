"""Near-duplicate texts by an exact set-similarity join: rarest-token prefixes, or a partition of the token universe.

Texts are sets of character sequences. Prefixes: two similar sets share one of their rarest tokens, so each set is
filed under those only, and pairs that meet are sifted by sizes and parity signatures before they are verified.

Partition: for sizes of one band, similarity at least t bounds the number of tokens in
which two sets may differ by some H. The universe is hashed into m segments; if a set spends H + 1 units on its
segments (one unit: the other set agrees exactly there; two: it differs by one token at most), then every similar set
meets it in some segment it paid for. Each set spends its units where that is cheapest by token frequency.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import written

#: Cells of the frequency sketch: a fixed size, whatever the corpus.
CELLS = 1 << 20
#: Segments for each unit to spend; above 1/2, so that costly segments can be passed over.
SPARE = 0.65
#: Sizes from here on are not told apart by the signatures; such sets are always verified.
LONG = (1 << 14) - 1
#: Rows of one key that are compared in one task; a more frequent key is split into blocks.
HOT = 50_000
#: Bytes of prefix rows in one part, which a task holds whole, and bytes that a token of a text takes there.
PART, EACH = 1 << 26, 5
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
SMALL = 1_000_000
_NEVER = 1e9
_END = "\U0010ffff"
_WORDLY: list[np.ndarray] = []
_U = np.uint64


def plain(text: str | None) -> str | None:
    """NFKC form in lower case, letters and digits only."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def plain_all(texts: list[str | None]) -> list[str | None]:
    """``plain`` of each text, over all characters at once; texts joined by a noncharacter."""
    joined = _END.join(t or "" for t in texts)
    if joined.count(_END) != max(0, len(texts) - 1):
        return [plain(t) for t in texts]
    if not _WORDLY:
        _WORDLY.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
        _WORDLY[0][ord(_END)] = True
    code = np.frombuffer(unicodedata.normalize("NFKC", joined).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = code[_WORDLY[0][code]].tobytes().decode("utf-32-le", "surrogatepass").split(_END)
    return [None if t is None else k for t, k in zip(texts, kept)]


def windows(texts: list[str], width: int = 3) -> np.ndarray:
    """All sequences of ``width`` characters of the texts, repeated ones too, in no order."""
    return tokens(texts, width, False)[1]


def tokens(texts: list[str], width: int = 3, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct sequences of ``width`` <= 3 characters as exact 63-bit numbers, and the row of each, rows in order."""
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.maximum(size - width + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(size) - size, count)
    if not distinct:
        value = np.zeros(len(at), _U)
        for k in range(width):
            value = (value << _U(21)) | code[at + k].astype(_U)
        return row, value
    # row and characters, these by their rank among the batch's own, make one number to sort by
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    letters = np.flatnonzero(seen).astype(np.uint64)
    bits = max(1, int(len(letters) - 1).bit_length())
    if bits * width + max(1, len(texts)).bit_length() > 63 and len(texts) > 1:
        half = len(texts) // 2
        left, right = tokens(texts[:half], width), tokens(texts[half:], width)
        return np.concatenate([left[0], right[0] + half]), np.concatenate([left[1], right[1]])
    rank = np.cumsum(seen)[code].astype(_U) - _U(1)
    number = row.astype(_U)
    for k in range(width):
        number = (number << _U(bits)) | rank[at + k]
    number = np.sort(number)
    number = number[np.append(True, number[1:] != number[:-1])] if len(number) else number
    value = np.zeros(len(number), _U)
    for k in range(width):
        value = (value << _U(21)) | letters[(number >> _U(bits * (width - 1 - k))) & _U((1 << bits) - 1)]
    return (number >> _U(bits * width)).astype(np.int64), value


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ _U(seed)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def bands(least: float, most: int = 1 << 24) -> np.ndarray:
    """Lower ends of the size bands: each ends where the similar sizes of its first size end."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(np.floor(out[-1] / least + 1e-9)) + 1))
    return np.array(out)


def segments(last: int, least: float) -> int:
    """Segments of the universe for sets of at most ``last`` tokens."""
    return max(1, int(np.ceil(SPARE * (differing(last, last, least) + 1))))


def differing(a, b, least: float):
    """In how many tokens sets of ``a`` and ``b`` tokens may differ."""
    return np.floor((1 - least) / (1 + least) * (a + b) + 1e-9).astype(np.int64) if isinstance(a, np.ndarray) else int((1 - least) / (1 + least) * (a + b) + 1e-9)


def _segment_keys(row: np.ndarray, token: np.ndarray, n: int, m: int, salt: int, freq: np.ndarray):
    """Cells (n x m): hash and the costs of one and two units; and each token's cell and the cell's hash without it."""
    mixed = _mix(token, 0x51ED)
    cell = row * m + ((mixed >> _U(33)) % _U(m)).astype(np.int64)
    total = np.zeros(n * m, _U)
    np.add.at(total, cell, _mix(token, 0xA7C3))
    where = _U(salt) * _U(0xD6E8FEB86659FD93) + np.tile(np.arange(m, dtype=np.uint64), n) * _U(0xC2B2AE3D27D4EB4F)
    whole = _mix(total + where, 0x1234)
    less = _mix(total[cell] - _mix(token, 0xA7C3) + where[cell], 0x1234)
    df = freq[(mixed & _U(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((df, cell))
    sorted_cell, sorted_df = cell[order], df[order]
    first = np.append(True, sorted_cell[1:] != sorted_cell[:-1]) if len(order) else np.zeros(0, bool)
    one, two = np.full(n * m, _NEVER), np.full(n * m, _NEVER)
    one[sorted_cell[first]] = sorted_df[first]
    second = np.flatnonzero(np.append(False, first[:-1]) & ~first) if len(order) else np.zeros(0, int)
    two[sorted_cell[second]] = sorted_df[second]
    return whole, one, np.maximum(two, one), cell, less


def _allocate(one: np.ndarray, two: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Units per segment, ``need`` in all, least cost first; the second unit of a segment never comes before its first."""
    m = one.shape[1]
    cost = np.concatenate([one, two], 1)
    rank = np.empty_like(cost, np.int64)
    np.put_along_axis(rank, np.argsort(cost, 1, kind="stable"), np.arange(2 * m)[None, :], 1)
    taken = rank < need[:, None]
    return taken[:, :m].astype(np.int8) + taken[:, m:]


def _signature(row: np.ndarray, token: np.ndarray, n: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parities of 176 token classes; two sets differ in at least as many tokens as parities. Low 14 bits of the last: the size."""
    place = (_mix(token, 0x77) % _U(176)).astype(np.int64)
    odd = (np.bincount(row * 176 + place, minlength=n * 176) & 1).reshape(n, 176).astype(np.uint64)
    one, two = ((odd[:, a : a + 64] << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64) for a in (0, 64))
    low = (odd[:, 128:] << np.arange(16, 64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return one, two, low | np.minimum(size, LONG).astype(np.uint64)


def _keys(ids: np.ndarray, texts: list[str], least: float, freq: np.ndarray):
    """Index and probe rows ``(key, who, s1, s2, s3)`` of a batch; ``who`` is -id - 1 for a probe and id for an index row."""
    row, token = tokens(texts)
    n = len(texts)
    size = np.bincount(row, minlength=n)
    sig = np.stack(_signature(row, token, n, size))
    lows = bands(least)
    own = np.searchsorted(lows, size, "right") - 1
    for band in np.unique(own[size > 0]):
        for b in (band, band + 1):
            inside = (own == band) & (size > 0)
            if b > band:  # as the smaller partner of sets of the next band
                inside &= np.floor(size / least + 1e-9) >= lows[b]
            pick = np.flatnonzero(inside)
            if not len(pick):
                continue
            number = np.full(n, -1)
            number[pick] = np.arange(len(pick))
            mine = inside[row]
            m = segments(int(lows[b + 1]) - 1, least)
            whole, one, two, cell, less = _segment_keys(number[row[mine]], token[mine], len(pick), m, int(b), freq)
            of = np.repeat(pick, m)
            by = pick[cell // m]
            yield whole, ids[of], *sig[:, of]
            yield less, ids[by], *sig[:, by]
            if b == band:
                units = _allocate(one.reshape(-1, m), two.reshape(-1, m), differing(size[pick], size[pick], least) + 1).ravel()
                paid = units >= 1
                yield whole[paid], -ids[of[paid]] - 1, *sig[:, of[paid]]
                double = units[cell] == 2
                yield less[double], -ids[by[double]] - 1, *sig[:, by[double]]


def _grouped(batches, columns: list[str], shift: int):
    """Batches of rows that come by key, each led by the rows of its first key that came before; and the number of those.

    The ``shift`` low bits of the first column only order the rows of a key.
    """
    held = None
    for batch in batches:
        now = [np.asarray(batch.column(c)) for c in columns]
        now[0] = now[0] >> shift
        if not len(now[0]):
            continue
        old = 0
        if held is not None and held[0][0] == now[0][0]:
            old = len(held[0])
            now = [np.concatenate(p) for p in zip(held, now)]
        yield old, now
        start = np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1]))[-1]
        held = [c[start:].copy() for c in now]


def _pair_part(batches, least: float):
    """Pairs of sets with a common key in one part of the prefix rows; see ``_pairs``. A part is held whole: PART bytes or a little more.

    Within a key, larger sets come first and probe the index rows after them.
    """
    held = [_unpacked(block) for batch in batches for block in batch.column("rows").to_pylist()]
    if not held:
        return
    who, *sig, count, flat = (np.concatenate(c) for c in zip(*held))
    del held
    up, flat = np.repeat(np.arange(len(who)), count), flat.astype(np.int64)
    order = np.argsort((flat >> 1 << 14) + (LONG - (sig[2][up] & _U(LONG)).astype(np.int64)), kind="stable")
    key, role, up = (flat >> 1)[order], (flat & 1)[order], up[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    cuts = np.unique(np.append(start[np.searchsorted(start, np.arange(0, len(key), 1 << 16))[:-1]] if len(start) > 1 else 0, len(key)))
    for a, b in zip(np.append(0, cuts[cuts > 0])[:-1], cuts[cuts > 0]):
        yield _pairs(0, key[a:b], who[up[a:b]], role[a:b], [c[up[a:b]] for c in sig], least, False)


def _pair_up(batches, least: float):
    """Pairs of sets with a common key by universe partition; rows come by key, ``who`` is -id - 1 for a probe and id for an index row."""
    for old, (key, who, role, *sig) in _grouped(batches, ["key", "who", "role", "s1", "s2", "s3"], 0):
        yield _pairs(old, key, who, role, sig, least, True)


def _pairs(old: int, key, who, role, sig: list[np.ndarray], least: float, partition: bool) -> pa.RecordBatch:
    """Pairs of rows of one key, the later one from ``old`` on, whose roles, sizes and signatures allow the similarity.

    Prefixes: an index row (``role`` 1) meets all rows before it. ``partition``: a probe meets index rows, in any order.
    """
    sig = [c.view(np.uint64) for c in sig]
    bound = (1 - least) / (1 + least) * (sig[2] & _U(LONG)).astype(np.float32) + np.float32(1e-4)
    first = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key)), 0))
    before = np.arange(len(key)) - first  # rows of the same key that came before
    new = np.arange(old, len(key))
    if partition:
        who, role = np.where(who < 0, -who - 1, who), (who >= 0).astype(role.dtype)
    else:
        new = new[role[new] > 0]
    cuts = np.searchsorted(np.cumsum(before[new]), np.arange(0, before[new].sum() + 1, 1 << 17))
    found = []
    for a, b in zip(cuts, np.append(cuts[1:], len(new))):
        later = new[a:b]
        times = before[later]
        x = np.arange(times.sum()) + np.repeat(first[later] - (np.cumsum(times) - times), times)
        y = np.repeat(later, times)
        if partition:
            ok = role[x] != role[y]
            x, y = x[ok], y[ok]
        near = np.flatnonzero(_possible([c[x] for c in sig], [c[y] for c in sig], bound[x] + bound[y]))
        p, q = who[x[near]], who[y[near]]
        found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1)[p != q])
    pair = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _possible(x: list[np.ndarray], y: list[np.ndarray], bound: np.ndarray) -> np.ndarray:
    """Whether no more parities differ than tokens may; sets too long for their size to be told apart always pass."""
    differ = np.bitwise_count(x[0] ^ y[0])
    differ += np.bitwise_count(x[1] ^ y[1])  # 176 parities at most: no overflow
    differ += np.bitwise_count((x[2] ^ y[2]) >> _U(16))
    fits = differ <= bound
    if bound.max(initial=0) >= LONG / 4:
        fits |= ((x[2] & _U(LONG)) == LONG) | ((y[2] & _U(LONG)) == LONG)
    return fits


def _similar(left: pa.Array, right: pa.Array, least: float) -> pa.Array:
    both = left.to_pylist(), right.to_pylist()
    n = len(left)
    row, token = tokens(both[0] + both[1])
    size = np.bincount(row, minlength=2 * n)
    at = row % n if n else row
    order = np.lexsort((token, at))
    at, token = at[order], token[order]
    twice = (at[1:] == at[:-1]) & (token[1:] == token[:-1])
    common = np.bincount(at[1:][twice], minlength=n)
    either = size[:n] + size[n:] - common
    return pa.array(np.divide(common, either, out=np.zeros(n), where=either > 0) >= least)


def _rarest_first(row: np.ndarray, df: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Order by row, frequency and token; by one number of all three where that tells them apart."""
    short = (row.astype(_U) << _U(53)) | (np.minimum(df, (1 << 23) - 1).astype(_U) << _U(30)) | (_mix(token, 0x6D) & _U((1 << 30) - 1))
    order = np.argsort(short)
    near = np.flatnonzero(short[order[1:]] == short[order[:-1]]) if len(order) else order
    if len(near) or (len(row) and (row[-1] >= 1 << 10 or df.max() >= 1 << 23)):
        return np.lexsort((token, _mix(token, 0x6D) & _U((1 << 30) - 1), df, row))
    return order


def _prefix_rows(ids: np.ndarray, texts: list[str], least: float, freq: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows ``(part, rows)``: the rarest tokens of each set, all that go to one part in one block, by planes of bytes of equal weight.

    Rarest by the sketch, ties by a digest of the token and the token. Of two similar sets, the larger one's first n - ceil(t n) + 1 tokens and
    the smaller one's first n - ceil(2 t n / (1 + t)) + 1 have one in common; bit 0 of a key tells the latter. Sets of LONG tokens
    or more come in any order within a key, so any of them may be the larger one that comes second: all their rows are index rows.
    """
    row, token = tokens(texts)
    n = len(texts)
    size = np.bincount(row, minlength=n)
    sig = np.stack(_signature(row, token, n, size))
    df = freq[(_mix(token, 0x51ED) & _U(CELLS - 1)).astype(np.int64)]
    order = _rarest_first(row, df, token)
    row, token, df = row[order], token[order], df[order]
    rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    probe = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    index = size - np.ceil(2 * least / (1 + least) * size - 1e-9).astype(np.int64) + 1
    keep = rank < probe[row]
    row, token, df, role = row[keep], token[keep], df[keep], ((rank < index[row]) | (size[row] >= LONG))[keep]
    hot = np.flatnonzero(df > HOT)
    if len(hot):  # a hot token is split into blocks of sets; each pair of blocks has a key of its own
        blocks = (df[hot] // HOT).astype(np.int64) + 1
        own = np.repeat((_mix(ids[row[hot]].view(_U), 0x9) % blocks.astype(_U)).astype(np.int64), blocks)
        other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        pair = (np.minimum(own, other) << 32) + np.maximum(own, other)
        split = np.repeat(token[hot], blocks) ^ _mix(pair.view(_U), 0x5)
        more = [np.repeat(c[hot], blocks) for c in (row, role)]
        row, role, token = (np.concatenate([np.delete(c, hot), d]) for c, d in ((row, more[0]), (role, more[1]), (token, split)))
    mixed = _mix(token, 0x3C)
    part = ((mixed >> _U(32)) % _U(parts)).astype(np.int64)
    key = ((mixed & _U(0x3FFFFFFF)) << _U(1) | role.astype(_U)).astype(np.int32)
    order = np.lexsort((row, part))
    row, part, key = row[order], part[order], key[order]
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))) if len(row) else np.zeros(0, np.int64)
    of, to, ends = row[head], part[head], np.append(head, len(row))
    edges = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    blocks = []
    for a, b in zip(edges, np.append(edges[1:], len(to))):
        mine = of[a:b]
        columns = (ids[mine], *(c[mine] for c in sig), np.diff(ends[a : b + 1]).astype(np.uint32), key[ends[a] : ends[b]])
        blocks.append(np.array([b - a, ends[b] - ends[a]]).tobytes() + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns))
    return pa.RecordBatch.from_arrays([pa.array(to[edges].astype(np.int32)), pa.array(blocks, pa.binary())], ["part", "rows"])


def _unpacked(block: bytes) -> list[np.ndarray]:
    """The columns ``who``, three of the signature, number of keys and ``keys`` of a packed block."""
    n, m = (int(x) for x in np.frombuffer(block[:16], np.int64))
    out, at = [], 16
    for kind, count in ((np.int64, n), (np.uint64, n), (np.uint64, n), (np.uint64, n), (np.uint32, n), (np.int32, m)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(block, np.uint8, count * width, at).reshape(width, count).T).view(kind).ravel())
        at += count * width
    return out


def _few(ids: DataFrame) -> DataFrame:
    """The one-column table ``ids``, to be broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def text_classes(records: DataFrame, rec: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables ``(rec, rep)`` of all records with a token and ``(rep, plain)`` of their distinct texts; ``rep`` is the first record of a text.

    Texts are told apart by two 64-bit digests of letters and digits; only digests and ids cross the shuffle.
    """
    base = records.select(F.col(rec).alias("rec"), F.arrow_udf(lambda t: pa.array(plain_all(t.to_pylist()), pa.string()), "string")(F.col(text)).alias("plain"))
    base = base.where(F.length("plain") >= 3).select("rec", "plain", F.xxhash64("plain").alias("h"), F.xxhash64(F.lit(1), "plain").alias("g"))
    base = written(base, "plain")
    same = base.groupBy("h", "g").agg(F.min("rec").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h", "g", "rep")
    copies = written(base.select("rec", "h", "g").join(same, ["h", "g"]).select("rec", "rep").distinct(), "copies")
    others = base.select("rec").join(_few(copies.select("rec")), "rec", "left_anti")
    members = copies.unionByName(others.select("rec", F.col("rec").alias("rep")))
    classes = base.join(_few(copies.where("rec <> rep").select("rec")), "rec", "left_anti")
    return members, classes.select(F.col("rec").alias("rep"), "plain")


def similar_classes(classes: DataFrame, least: float = 0.6, method: str = "prefix") -> DataFrame:
    """``(a, b)``, ``a`` < ``b``: representatives whose texts' token sets have Jaccard similarity ``least`` or more. Exact.

    ``method``: ``partition`` is the universe partition with one-deletion neighbourhoods; it sends some 300 rows a text
    through the shuffle. ``prefix`` sends a row for each of a text's rarest tokens, about 0.4 of them at 0.6.
    Both order or allocate by the corpus' token frequencies, a sketch of CELLS counters that steers the work and
    not the result. The number of parts follows from the counted tokens, so that a task's rows fit its memory.
    """
    spark = classes.sparkSession

    def tally(batches):
        for batch in batches:
            count = np.bincount((_mix(windows(batch.column("plain").to_pylist()), 0x51ED) & _U(CELLS - 1)).astype(np.int64))
            cell = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(count[cell].astype(np.int64))], ["cell", "n"])

    counts = classes.select("plain").mapInArrow(tally, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    freq = np.zeros(CELLS)
    freq[np.asarray(counts.column("cell"))] = np.asarray(counts.column("n"))
    held = spark.sparkContext.broadcast(freq.astype(np.float32))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(freq.sum() * EACH) // PART)

    def pieces(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                yield np.asarray(part.column("rep")), part.column("plain").to_pylist()

    def partition_rows(batches):
        for ids, texts in pieces(batches):
            for columns in _keys(ids, texts, least, held.value):
                for b in range(0, len(columns[0]), 1 << 16):
                    key, who, *sig = (c[b : b + (1 << 16)].view(np.int64) for c in columns)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(np.zeros(len(key), np.int32)), *map(pa.array, sig)], ["key", "who", "role", "s1", "s2", "s3"])

    def prefix_rows(batches):
        for ids, texts in pieces(batches):
            yield _prefix_rows(ids, texts, least, held.value, parts)

    if method == "partition":
        rows = classes.mapInArrow(partition_rows, "key bigint, who bigint, role int, s1 bigint, s2 bigint, s3 bigint").repartition("key")
        met = rows.sortWithinPartitions("key").mapInArrow(lambda b: _pair_up(b, least), "a bigint, b bigint").distinct()
    else:
        packed = classes.mapInArrow(prefix_rows, "part int, rows binary").repartitionById(parts, "part")
        met = packed.mapInArrow(lambda b: _pair_part(b, least), "a bigint, b bigint").distinct()
    met = written(met, "met")
    wanted = classes.join(_few(met.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "rep", "left_semi").distinct()
    texts, other = wanted.select(F.col("rep").alias("a"), F.col("plain").alias("_x")), wanted.select(F.col("rep").alias("b"), F.col("plain").alias("_y"))
    return met.join(texts, "a").join(other, "b").where(F.arrow_udf(lambda x, y: _similar(x, y, least), "boolean")("_x", "_y")).select("a", "b")


def near_duplicates(records: DataFrame, rec: str, text: str, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """``(members(rec, rep), links(a, b))``: every record with a token under its class, and the similar pairs of classes.

    Copies (equal letters and digits) are one class and are not paired with each other here. Null, blank and too
    short texts are in no class. Ids are 64-bit integers, not negative, unique.
    """
    members, classes = text_classes(records, rec, text)
    members = written(members, "members")
    return members, similar_classes(classes, least)


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(rec_a, rec_b)``, the smaller first: all pairs of similar records, copies among them."""
    within = members.alias("x").join(members.alias("y"), F.col("x.rep") == F.col("y.rep")).where("x.rec < y.rec").select(F.col("x.rec").alias("rec_a"), F.col("y.rec").alias("rec_b"))
    left, right = members.select(F.col("rep").alias("a"), F.col("rec").alias("_l")), members.select(F.col("rep").alias("b"), F.col("rec").alias("_r"))
    across = links.join(left, "a").join(right, "b").select(F.least("_l", "_r").alias("rec_a"), F.greatest("_l", "_r").alias("rec_b"))
    return within.unionByName(across)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(rec, class_id, group_id, links)``: each record's class, the class's connected group, and its number of similar classes.

    Groups take the smallest class id by label exchange over the links; labels are cut by a written table each round.
    """
    both = written(links.union(links.select("b", "a")).toDF("a", "b"), "links")
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("links"))
    label = written(label, "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("label").alias("_l")), "b").groupBy("a").agg(F.min("_l").alias("_l"))
        jump = label.select(F.col("a").alias("label"), F.col("label").alias("_j"))
        new = label.join(near, "a").join(jump, "label", "left").select("a", F.least("label", "_l", "_j").alias("label"), "links", F.col("label").alias("_old"))
        new = written(new, "labels")
        if not new.where("label <> _old").limit(1).count():
            break
        label = new.drop("_old")
    mine = label.select(F.col("a").alias("rep"), "label", "links")
    return members.join(mine, "rep", "left").select("rec", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
