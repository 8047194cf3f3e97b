"""JSON text as Arrow nodes: a structural scan over the string buffer of a whole batch.

The scan works on the bytes of all texts of a batch at once (quotes, escapes, brackets, commas), so its
cost per record is a few vector passes and no record is handed to a parser. Its result is a node table in
which a child names its parent by index, as Arrow's list kernels do, so that any value of the parent is
propagated to the children with one ``take``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_STRING = r'^(?:[^\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*$'
_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COMMA, _COLON, _QUOTE, _BACK = (ord(c) for c in '{}[],:"\\')
_EMPTY, _LEFT, _RIGHT = (pa.scalar(x, pa.large_string()) for x in ("", "[", "]"))
_STR, _SCA = 1, 2  # token kinds beside the six structural bytes


@dataclass
class Nodes:
    """JSON values of a batch in text order. ``parent`` is -1 for a root; ``pos`` is -1 outside arrays."""

    valid: np.ndarray  # per input row: holds a complete JSON object
    row: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    pos: np.ndarray
    kind: np.ndarray  # '{', '[', _STR or _SCA
    key: pa.Array  # decoded member name, null outside objects
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def is_scalar(self) -> np.ndarray:
        return (self.kind == _STR) | (self.kind == _SCA)

    def is_string(self) -> np.ndarray:
        return self.kind == _STR

    def text(self, which: np.ndarray) -> pa.Array:
        """Decoded strings and literals as written, for the node indices ``which``."""
        raw = _slices(self.data, self.start[which], self.end[which])
        return _decoded(raw, self.kind[which] == _STR)


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Cut ``data[start:end]`` for all pairs into one Arrow string array without a Python loop."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])])


def _decoded(raw: pa.Array, is_string: np.ndarray) -> pa.Array:
    escaped = np.asarray(pc.match_substring(raw, "\\")) & is_string
    if not escaped.any():
        return raw
    hit = np.flatnonzero(escaped)
    coded = raw.take(pa.array(hit)).dictionary_encode()
    plain = pa.array([json.loads(f'"{x}"').encode("utf-8", "replace").decode() for x in coded.dictionary.to_pylist()], pa.large_string())
    return pc.replace_with_mask(raw, pa.array(escaped), plain.take(coded.indices))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _first_object(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row, the place of the first ``{`` before a member name or ``}``; the row's end if there is none."""
    solid = np.flatnonzero(~np.isin(data, (32, 9, 10, 13)))
    brace = np.flatnonzero(data == _OPEN_O)
    after = np.searchsorted(solid, brace, "right")
    follows = data[solid[np.minimum(after, len(solid) - 1)]] if len(solid) else np.zeros(0, np.uint8)
    good = brace[(after < len(solid)) & ((follows == _QUOTE) | (follows == _CLOSE_O))]
    at = np.searchsorted(good, offsets[:-1])
    found = np.append(good, len(data))[at]
    return np.minimum(found, offsets[1:])


def nodes(texts: pa.Array, lenient: bool = False, arrays: bool = False) -> Nodes:
    """Scan a batch of JSON texts.

    Strict: a text is valid if the whole of it is one JSON object (with ``arrays``, or one array). Lenient: text before and after the first
    object is passed over, and so is a comma before a closing bracket. A row that is not valid has no nodes.
    Of equal member names in one object the last one counts. Null and empty texts are not valid.
    """
    data, offsets = _flat(texts)
    n = len(offsets) - 1
    begin = _first_object(data, offsets) if lenient else offsets[:-1]
    back = data == _BACK
    quote = np.flatnonzero(data == _QUOTE)
    if back.any():
        plain = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
        row = np.searchsorted(offsets, quote, "right") - 1
        run = np.where(quote > 0, quote - 1 - plain[np.maximum(quote - 1, 0)], 0)
        quote = quote[np.minimum(run, quote - offsets[row]) % 2 == 0]
    qrow = np.searchsorted(offsets, quote, "right") - 1
    keep = quote >= begin[qrow] if len(quote) else np.zeros(0, bool)
    quote, qrow = quote[keep], qrow[keep]
    first_q = np.searchsorted(quote, offsets[:-1])
    nth = np.arange(len(quote)) - first_q[qrow] if len(quote) else np.zeros(0, int)
    unclosed = np.diff(np.append(first_q, len(quote))) % 2 == 1
    last = np.append(quote[1:], 0) if len(quote) else quote
    opens = nth % 2 == 0
    ends = np.where(np.append(qrow[1:], -1) == qrow, last, offsets[qrow + 1] - 1)[opens] if len(quote) else quote
    starts, srow = quote[opens], qrow[opens]

    toggle = np.zeros(len(data) + 1, np.int32)
    np.add.at(toggle, starts, 1)
    np.add.at(toggle, ends + 1, -1)
    inside = np.cumsum(toggle[:-1]) > 0
    skipped = np.zeros(len(data) + 1, np.int32)
    np.add.at(skipped, offsets[:-1], 1)
    np.add.at(skipped, begin, -1)
    outside = ~inside & ~(np.cumsum(skipped[:-1]) > 0)
    control = np.flatnonzero(inside & (data < 32))
    structural = np.isin(data, (_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COMMA, _COLON)) & outside
    other = outside & ~structural & ~np.isin(data, (32, 9, 10, 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, other[:-1]) if len(other) else other
    v_start = np.flatnonzero(other & (~before | edge[:-1]))
    after = np.append(other[1:], False) if len(other) else other
    v_end = np.flatnonzero(other & (~after | edge[1:])) + 1
    s_pos = np.flatnonzero(structural)

    pos = np.concatenate([s_pos, starts, v_start])
    end = np.concatenate([s_pos + 1, ends + 1, v_end])
    kind = np.concatenate([data[s_pos], np.full(len(starts), _STR, np.uint8), np.full(len(v_start), _SCA, np.uint8)])
    order = np.argsort(pos, kind="stable")
    pos, end, kind = pos[order], end[order], kind[order]
    row = np.searchsorted(offsets, pos, "right") - 1

    # enclosing containers of every token, and where the first value of each row is over
    is_open, is_close = (kind == _OPEN_O) | (kind == _OPEN_A), (kind == _CLOSE_O) | (kind == _CLOSE_A)
    step = is_open.astype(np.int64) - is_close
    total = np.cumsum(step)
    first = np.searchsorted(row, np.arange(n))
    base = np.append(0, total)[first]
    after_depth = total - base[row] if len(row) else total
    over = np.flatnonzero(after_depth <= 0)
    at = np.searchsorted(over, first)
    over_at = np.append(over, len(row))[at]  # token that ends the row's first value
    count = np.diff(np.append(first, len(row)))
    valid = (count > 0) & (over_at < first + count)
    starts_object = np.zeros(n, bool)
    starts_object[count > 0] = np.isin(kind[first[count > 0]], (_OPEN_O, _OPEN_A) if arrays else (_OPEN_O,))
    valid &= starts_object
    if not lenient:
        valid &= (over_at == first + count - 1) & ~unclosed
    elif unclosed.any():
        tail = np.append(pos, 0)[np.minimum(over_at, len(pos))]
        open_q = np.zeros(n, np.int64)
        open_q[qrow] = quote  # the last quote of the row
        valid &= ~unclosed | (tail < open_q)
    crow = np.searchsorted(offsets, control, "right") - 1
    limit = np.append(pos, 0)[np.minimum(over_at, len(pos))]
    valid[crow[control < limit[crow]]] = False

    use = valid[row] & (np.arange(len(row)) <= over_at[row]) if len(row) else np.zeros(0, bool)
    pos, end, kind, row, is_open, is_close, after_depth = (x[use] for x in (pos, end, kind, row, is_open, is_close, after_depth))
    if lenient and len(row):
        trailing = (kind == _COMMA) & np.append(is_close[1:], False)
        pos, end, kind, row, is_open, is_close, after_depth = (x[~trailing] for x in (pos, end, kind, row, is_open, is_close, after_depth))
    depth = after_depth - is_open  # containers round the token
    parent = np.full(len(row), -1, np.int64)
    match = np.full(len(row), -1, np.int64)
    for level in range(int(depth.max(initial=0)) + 1):
        own = np.flatnonzero(is_open & (depth == level))
        inner = np.flatnonzero(depth == level + 1)
        if len(inner):
            parent[inner] = own[np.searchsorted(own, inner) - 1]
        closing = np.flatnonzero(is_close & (depth == level))
        if len(closing):
            match[closing] = own[np.searchsorted(own, closing) - 1]

    # grammar: every token against the one before it and its container
    size = len(row)
    in_object = np.zeros(size, bool)
    in_object[parent >= 0] = kind[parent[parent >= 0]] == _OPEN_O
    in_array = (parent >= 0) & ~in_object
    prev = np.append(0, kind[:-1]) if size else kind
    is_first = np.append(True, row[1:] != row[:-1]) if size else np.zeros(0, bool)
    is_key = (kind == _STR) & in_object & ((prev == _OPEN_O) | (prev == _COMMA))
    prev_key = np.append(False, is_key[:-1]) if size else is_key
    prev_value = ((prev == _STR) & ~prev_key) | (prev == _SCA) | (prev == _CLOSE_O) | (prev == _CLOSE_A)
    value = is_open | (kind == _SCA) | ((kind == _STR) & ~is_key)
    fine = is_key.copy()
    fine |= value & (is_first | (in_object & (prev == _COLON)) | (in_array & ((prev == _OPEN_A) | (prev == _COMMA))))
    fine |= (kind == _COLON) & prev_key
    fine |= (kind == _COMMA) & prev_value & (parent >= 0)
    close_ok = np.zeros(size, bool)
    closing = np.flatnonzero(is_close)
    close_ok[closing] = kind[match[closing]] == np.where(kind[closing] == _CLOSE_O, _OPEN_O, _OPEN_A)
    fine |= is_close & close_ok & (prev_value | (prev == np.where(kind == _CLOSE_O, _OPEN_O, _OPEN_A)))
    scalar = np.flatnonzero(kind == _SCA)
    if len(scalar):
        fine[scalar] &= np.asarray(pc.match_substring_regex(_slices(data, pos[scalar], end[scalar]), _SCALAR))
    string = np.flatnonzero(kind == _STR)
    if len(string) and back.any():
        seen = np.append(0, np.cumsum(back))
        string = string[seen[end[string]] > seen[pos[string]]]
        if len(string):
            fine[string] &= np.asarray(pc.match_substring_regex(_slices(data, pos[string] + 1, end[string] - 1), _STRING))
    valid[row[~fine]] = False

    # nodes: the value tokens of valid rows, their member names and places
    good = valid[row] if size else np.zeros(0, bool)
    commas = np.flatnonzero(in_array & good & ((kind == _COMMA) | value))
    place = np.full(size, -1, np.int64)
    if len(commas):
        grouped = commas[np.argsort(parent[commas], kind="stable")]
        comma = (kind[grouped] == _COMMA).astype(np.int64)
        head = np.append(True, parent[grouped][1:] != parent[grouped][:-1])
        seen = np.cumsum(comma)
        place[grouped] = seen - np.maximum.accumulate(np.where(head, seen - comma, 0))
    node = np.flatnonzero(value & good)
    number = np.full(size, -1, np.int64)
    number[node] = np.arange(len(node))
    up = np.where(parent[node] >= 0, number[np.maximum(parent[node], 0)], -1)
    keyed = in_object[node]
    at = node[keyed] - 2
    names = _decoded(_slices(data, pos[at] + 1, end[at] - 1), np.ones(len(at), bool))
    key = pa.nulls(len(node), pa.large_string())
    if len(at):
        key = pc.replace_with_mask(key, pa.array(keyed), names)
    is_str = kind[node] == _STR
    out = Nodes(valid, row[node], up, depth[node], np.where(keyed, -1, place[node]), kind[node], key, pos[node] + is_str, end[node] - is_str, data)
    return _last_wins(out, keyed)


def _last_wins(x: Nodes, keyed: np.ndarray) -> Nodes:
    """Drop members whose name comes again later in the same object, with all below them."""
    hit = np.flatnonzero(keyed)
    if not len(hit):
        return x
    code = np.asarray(x.key.take(pa.array(hit)).dictionary_encode().indices).astype(np.int64)
    both = x.parent[hit] * (int(code.max()) + 1) + code
    _, latest = np.unique(both[::-1], return_index=True)
    if len(latest) == len(hit):
        return x
    gone = np.zeros(len(x.row), bool)
    gone[np.delete(hit, len(hit) - 1 - latest)] = True
    for level in range(1, int(x.depth.max()) + 1):
        own = np.flatnonzero((x.depth == level) & (x.parent >= 0))
        gone[own] |= gone[x.parent[own]]
    keep = np.flatnonzero(~gone)
    number = np.cumsum(~gone) - 1
    up = np.where(x.parent[keep] >= 0, number[np.maximum(x.parent[keep], 0)], -1)
    return Nodes(x.valid, x.row[keep], up, x.depth[keep], x.pos[keep], x.kind[keep], x.key.take(pa.array(keep)), x.start[keep], x.end[keep], x.data)


def ancestors(x: Nodes, which: np.ndarray, level: int) -> np.ndarray:
    """For each node of ``which`` its ancestor (or itself) at depth ``level``; -1 where the node is higher."""
    at = which.copy()
    for _ in range(int(x.depth[which].max(initial=0))):
        deeper = (at >= 0) & (x.depth[np.maximum(at, 0)] > level)
        if not deeper.any():
            break
        at[deeper] = x.parent[at[deeper]]
    at[(at >= 0) & (x.depth[np.maximum(at, 0)] < level)] = -1
    return at


def names_of(x: Nodes, which: np.ndarray) -> pa.Array:
    """Member name, or ``[i]`` in an array."""
    keys = x.key.take(pa.array(which))
    index = pc.binary_join_element_wise(_LEFT, pa.array(x.pos[which]).cast(pa.large_string()), _RIGHT, _EMPTY)
    return pc.coalesce(keys, index)


def paths(x: Nodes, prefix: pa.Array | None = None) -> pa.Array:
    """Path of every node, built level by level from the parents' paths; ``prefix`` has the path of each input row's root."""
    n = len(x.row)
    out = np.full(n, "", object)
    if prefix is not None:
        roots = np.flatnonzero(x.parent < 0)
        out[roots] = prefix.to_numpy(zero_copy_only=False)[x.row[roots]]
    for level in range(1, int(x.depth.max(initial=0)) + 1):
        own = np.flatnonzero(x.depth == level)
        if not len(own):
            continue
        above = pa.array(out[x.parent[own]], pa.large_string())
        in_array = x.pos[own] >= 0
        dot = pa.array(np.where(in_array | np.asarray(pc.equal(above, "")), "", "."), pa.large_string())
        out[own] = pc.binary_join_element_wise(above, dot, names_of(x, own), _EMPTY).to_numpy(zero_copy_only=False)
    return pa.array(out, pa.large_string())


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """Cut a batch so that the texts of ``column`` in one piece stay near ``limit`` bytes (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // limit
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(sizes))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def members(texts: pa.Array, wanted: list[str], lenient: bool = False) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Validity of each text, and the top-level scalar members ``wanted`` (null: absent, null or not a scalar)."""
    x = nodes(texts, lenient)
    top = np.flatnonzero((x.depth == 1) & x.is_scalar())
    keys = x.key.take(pa.array(top))
    out = {}
    for name in wanted:
        own = top[np.asarray(pc.equal(keys, pa.scalar(name, pa.large_string())))]
        values = x.text(own)
        null = np.asarray(pc.equal(values, pa.scalar("null", pa.large_string()))) & ~x.is_string()[own]
        index = np.full(len(texts), -1, np.int64)
        index[x.row[own[~null]]] = np.flatnonzero(~null)
        out[name] = values.take(pa.array(index, mask=index < 0)).cast(pa.string())
    return pa.array(x.valid), out


def member_columns(df, text: str, wanted: list[str], keep: list[str], valid: str = "is_json", lenient: bool = False):
    """DataFrame of ``keep``, a flag for a complete JSON object and one text column per wanted top-level member.

    Names in ``wanted`` come out as ``m_<name>``, so they cannot clash with columns of the input.
    """
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(valid, T.BooleanType())] + [T.StructField(f"m_{w}", T.StringType()) for w in wanted])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text):
                flag, found = members(piece.column(text), wanted, lenient)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), flag, *found.values()], [*keep, valid, *(f"m_{w}" for w in found)])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
