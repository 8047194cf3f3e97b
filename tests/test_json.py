import json
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions.json_arrow import members, nodes, paths
from factloom.operators.json_flatten import flat_scalars, node_table, under_containers, under_members

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=20,
)


def flat(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flat(v, f"{path}[{i}]")
    else:
        yield path, value if isinstance(value, str) else json.dumps(value)


def scan(texts, lenient=False):
    x = nodes(pa.array(texts, pa.string()), lenient)
    path, scalar = paths(x).to_pylist(), np.flatnonzero(x.is_scalar())
    out = {i: [] for i in np.flatnonzero(x.valid)}
    for i, t in zip(scalar, x.text(scalar).to_pylist()):
        out[x.row[i]].append((path[i], t))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), VALUES, max_size=5), min_size=1, max_size=6), st.booleans(), st.integers(0, 2))
def test_scan_equals_parser(objects, ascii_only, indent):
    texts = [json.dumps(o, ensure_ascii=ascii_only, indent=indent or None) for o in objects]
    texts = [t if t.encode("utf-8", "ignore").decode() == t else "{}" for t in texts]
    got = scan(texts)
    for i, t in enumerate(texts):
        want = [(p, v.encode("utf-8", "replace").decode()) for p, v in flat(json.loads(t))]
        assert got[i] == want


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=4), VALUES, min_size=1, max_size=4), st.data())
def test_broken_text_is_invalid(value, data):
    text = json.dumps(value)
    at = data.draw(st.integers(0, len(text) - 1))
    change = data.draw(st.sampled_from(["", ",", "}", "]", '"', ":", "x", "{"]))
    broken = text[:at] + change + text[at + 1 :]
    try:
        fine = isinstance(json.loads(broken), dict)
    except ValueError:
        fine = False
    assert bool(nodes(pa.array([broken, "{}"])).valid[0]) == fine


def test_lenient_texts():
    good = ['Here: {"a": [1, 2,],}\nThat is all "', '﻿{"a":{}}', '```json\n{"a":"}"}\n```', "{ }"]
    bad = [None, "", "nothing", '{"a": 1', '{"a":[1,2}', "{a:1}", '{"a" 1}', '{"a":1,,}']
    assert nodes(pa.array(good + bad), lenient=True).valid.tolist() == [True] * 4 + [False] * 8
    assert scan(good, True)[0] == [("a[0]", "1"), ("a[1]", "2")]


def test_last_of_equal_names_counts():
    assert scan(['{"a":{"b":1,"b":[2]},"a":{"c":3,"b":4,"b":5}}'])[0] == [("a.c", "3"), ("a.b", "5")]


def test_members_and_bytes_across_slices():
    valid, found = members(pa.array(['{"d":1,"t":null,"x":{"d":2}}', "[1]", None, '{"d":"\\u4e2d"}']).slice(0, 4), ["d", "t"])
    assert valid.to_pylist() == [True, False, False, True]
    assert found["d"].to_pylist() == ["1", None, None, "中"] and found["t"].to_pylist() == [None] * 4


PAYLOAD = {
    "entities": [{"id": "E1", "attributes": {"k": [{"name": "x"}, 1.50, None, True], "n": ""}}, {"attributes": '{"a": ["b"]}'}, {"attributes": "plain"}],
    "relations": [{"attributes": [{"key": "q"}]}, 5],
    "other": [{"attributes": {"z": 1}}],
}


def test_flatten_attributes(spark, rows):
    long = json.dumps({"entities": [{"attributes": {"t": "長" * 300_000}}]})
    df = spark.createDataFrame([(1, json.dumps(PAYLOAD), "p"), (2, None, "q"), (3, "", "q"), (4, long, None)], "extraction_id bigint, payload string, parent string")
    got = rows(flat_scalars(df, "extraction_id", "payload", under_members({"attributes": ("entities", "relations")}), lenient=True))
    assert got[:-1] == sorted(
        [(1, "entities[0].attributes.k[0]", "name", "x"), (1, "entities[0].attributes.k", "[1]", "1.5"), (1, "entities[0].attributes.k", "[3]", "true"), (1, "entities[0].attributes", "n", ""), (1, "entities[1].attributes.a", "[0]", "b"), (1, "relations[0].attributes[0]", "key", "q")],
        key=str,
    )
    assert got[-1][:3] == (4, "entities[0].attributes", "t") and len(got[-1][3]) == 300_000


def test_flatten_containers_empty_and_repeated(spark, rows):
    df = spark.createDataFrame([(1, '{"a":1,"b":{"c":[2,{"d":null}]}}'), (1, '{"a":1,"b":{"c":[2,{"d":null}]}}'), (2, '{"b":{"c":3}')], "r int, t string")
    assert rows(flat_scalars(df, "r", "t", under_containers)) == [(1, "b.c", "[0]", "2")] * 2
    assert rows(flat_scalars(df.limit(0), "r", "t", under_containers)) == []


def test_node_table_links_children(spark):
    df = spark.createDataFrame([(7, '{"a":[{"b":"c"}],"e":{}}')], "r bigint, t string")
    got = {r["node"]: r for r in node_table(df, "r", "t").collect()}
    assert [(n, got[n]["parent_node"], got[n]["path"], got[n]["kind"], got[n]["val"]) for n in sorted(got)] == [
        (0, None, "", "object", None), (1, 0, "a", "array", None), (2, 1, "a[0]", "object", None), (3, 2, "a[0].b", "string", "c"), (4, 0, "e", "object", None)]
    assert re.fullmatch(r"\[0\]", got[2]["field"])
