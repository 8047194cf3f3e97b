"""Deeply nested JSON records to flat tables that keep the link to their record and enclosing object."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.functions.json_arrow import Nodes, ancestors, names_of, nodes, paths, slices

Picker = Callable[[Nodes], tuple[np.ndarray, np.ndarray]]


def _large(x: pa.Array) -> pa.Array:
    return x.cast(pa.large_string())


def _is(x: Nodes, which: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.is_in(x.key.take(pa.array(which)), pa.array(names, pa.large_string())), False))


def under_members(levels: dict[str, tuple[str, ...]]) -> Picker:
    """Scalars below the named member of each element of top-level arrays, e.g. ``{"attributes": ("entities", "relations")}``.

    Also gives the text values of that member itself, whose JSON content counts in its place.
    """

    def pick(x: Nodes) -> tuple[np.ndarray, np.ndarray]:
        holders = np.flatnonzero((x.depth == 3) & (x.parent >= 0))
        keep = np.zeros(len(holders), bool)
        element = x.parent[holders]
        array = np.where(element >= 0, x.parent[element], -1)
        for member, arrays in levels.items():
            keep |= _is(x, holders, (member,)) & (x.pos[element] >= 0) & _is(x, array, arrays)
        held = np.zeros(len(x.row), bool)
        held[holders[keep]] = True
        scalars = np.flatnonzero(x.is_scalar() & (x.depth > 3))
        top = ancestors(x, scalars, 3)
        return scalars[held[top]] if len(scalars) else scalars, np.flatnonzero(held & x.is_string())

    return pick


def under_containers(x: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Scalars below any top-level member that is an object or array."""
    return np.flatnonzero(x.is_scalar() & (x.depth > 1)), np.zeros(0, np.int64)


def _rows(x: Nodes, which: np.ndarray, path: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    value = x.text(which)
    null = ~x.is_string()[which] & np.asarray(pc.equal(value, pa.scalar("null", pa.large_string())))
    which, value = which[~null], value.filter(pa.array(~null))
    return x.row[which], [path.take(pa.array(x.parent[which])), names_of(x, which), value]


def flat_scalars(df: DataFrame, rec: str, text: str, pick: Picker, lenient: bool = False) -> DataFrame:
    """One row ``(<rec>, parent, field, val)`` for each non-null scalar that ``pick`` chooses, at any depth.

    ``parent`` is the path of the enclosing object or array, ``field`` the member name or ``[i]``, ``val`` the
    decoded text or the literal as written. No shuffle: every batch is flattened where it is read, and the
    record key is propagated by ``take`` over the parent index. Null, empty and unreadable texts give no rows;
    other columns of ``df`` are not read; repeated input rows give repeated output rows.
    """
    key = df.schema[rec]
    schema = T.StructType([key, *(T.StructField(c, T.StringType()) for c in ("parent", "field", "val"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                x = nodes(piece.column(text), lenient)
                scalars, held = pick(x)
                path = paths(x)
                row, columns = _rows(x, scalars, path)
                parts = [(row, columns)]
                if len(held):
                    inner = nodes(x.text(held), arrays=True)
                    row, columns = _rows(inner, np.flatnonzero(inner.is_scalar()), paths(inner, path.take(pa.array(held))))
                    parts.append((x.row[held][row], columns))
                for row, columns in parts:
                    yield pa.RecordBatch.from_arrays([piece.column(rec).take(pa.array(row)), *(c.cast(pa.string()) for c in columns)], [rec, "parent", "field", "val"])

    return df.select(rec, text).mapInArrow(run, schema)


def node_table(df: DataFrame, rec: str, text: str, lenient: bool = False) -> DataFrame:
    """Every value of every record as ``(<rec>, node, parent_node, depth, path, field, kind, val)``.

    ``node`` numbers a record's values in text order from 0 (the root), ``parent_node`` is null for the root;
    ``kind`` is object, array, string or literal; ``val`` is null for containers. Unreadable texts give no rows.
    """
    schema = T.StructType(
        [df.schema[rec], T.StructField("node", T.LongType()), T.StructField("parent_node", T.LongType()), T.StructField("depth", T.IntegerType())]
        + [T.StructField(c, T.StringType()) for c in ("path", "field", "kind", "val")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                x = nodes(piece.column(text), lenient)
                everything = np.arange(len(x.row))
                base = np.searchsorted(x.row, x.row)
                kind = pc.choose(pa.array(np.select([x.kind == ord("{"), x.kind == ord("["), x.is_string()], [0, 1, 2], 3)), *(pa.scalar(k) for k in ("object", "array", "string", "literal")))
                value = pc.if_else(pa.array(x.is_scalar()), x.text(everything), pa.scalar(None, pa.large_string()))
                up = pa.array(x.parent - base, mask=x.parent < 0)
                field = pc.if_else(pa.array(x.parent >= 0), names_of(x, everything), pa.scalar(None, pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(rec).take(pa.array(x.row)), pa.array(everything - base), up, pa.array(x.depth.astype(np.int32)), *(c.cast(pa.string()) for c in (paths(x), field, kind, value))],
                    schema.names,
                )

    return df.select(rec, text).mapInArrow(run, schema)
