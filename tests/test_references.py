import json
from datetime import datetime as dt

from factloom.operators.references import edge_orphans, orphan_keys, orphan_report, payload_orphans

ENTITY = "name string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
EDGE = "edge_id bigint, source_name string, target_name string, loaded_at timestamp_ntz, reason string"


def day(n):
    return dt(2024, 1, n)


def test_edges(spark, rows):
    entities = spark.createDataFrame([("a", day(1), None), ("a", day(1), None), ("late", day(9), None), ("gone", day(1), day(3)), ("again", day(1), day(3)), ("again", day(4), None), (None, day(1), None)], ENTITY)
    edges = spark.createDataFrame(
        [(1, "a", "late", day(5), "x"), (1, "a", "late", day(5), "x"), (2, "gone", "again", day(5), None), (3, "again", "again", day(3), None), (4, None, "  ", day(5), None), (5, "nobody", "a", day(1), None), (6, "gone", "a", None, None)], EDGE)
    got = rows(edge_orphans(edges, entities), "edge_id", "field", "ref", "reason")
    assert got == sorted([(1, "target_name", "late", "late"), (2, "source_name", "gone", "deleted"), (3, "source_name", "again", "deleted"), (3, "target_name", "again", "deleted"), (5, "source_name", "nobody", "missing"), (6, "source_name", "gone", "deleted")], key=str)
    assert len(rows(edge_orphans(edges, entities.limit(0)))) == 10
    assert rows(edge_orphans(edges.limit(0), entities)) == []
    assert rows(orphan_report(edge_orphans(edges, entities), "t"), "month", "n")[-1][1] >= 1


def test_payloads(spark, rows):
    one = {"entities": [{"id": " e1"}, {"id": "E2"}, {"id": None}], "relations": [{"source": "E1、e2 , E3", "target": ["E9", None, "e9"]}, {"source": "", "target": 5}, {"target": {"id": "E7"}}]}
    two = {"entities": [{"id": "E9"}], "relations": []}
    data = [(1, "d", 1, json.dumps(one), day(1)), (1, "d", 1, json.dumps(one), day(1)), (2, "d", 2, json.dumps(two), day(2)), (3, "d", 3, '{"entities":[{"id":"E3"}', day(3)), (4, None, 1, json.dumps(one), day(1)), (5, "e", 1, None, day(1))]
    df = spark.createDataFrame(data, "extraction_id bigint, doc_id string, round_no int, payload string, loaded_at timestamp_ntz").selectExpr("*", "1 pos", "'z' ref")
    got = rows(payload_orphans(df), "extraction_id", "pos", "field", "ref", "reason")
    want = [(1, 0, "source", "E3", "missing"), (1, 0, "target", "E9", "late"), (1, 1, "target", "5", "missing"), (4, 0, "source", "E3", "missing"), (4, 0, "target", "E9", "missing"), (4, 1, "target", "5", "missing")]
    assert got == sorted(want, key=str)
    assert rows(payload_orphans(df.limit(0))) == []


def test_orphan_keys_leaves_out_nulls(spark, rows):
    refs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "k int, v string")
    assert rows(orphan_keys(refs, refs.where("k = 3"), ["k", "v"])) == [(1, "a")]
