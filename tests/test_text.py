import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx


def one(spark, expr, **values):
    schema = ", ".join(f"`{k}` string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("raw,want", [("﻿ 　a b\n", "a b"), ("", ""), (None, None), ("x" * 200_000 + "\t", "x" * 200_000)])
def test_strip(spark, raw, want):
    assert one(spark, tx.strip_text("t"), t=raw) == want


@pytest.mark.parametrize("raw,clean,safe", [('```JSON\n{"a":1,}\n```', '{"a":1,}', '{"a":1}'), ('{"a":1} x', '{"a":1} x', None), ("", "", None), (None, None, None), ("[1]", "[1]", "[1]")])
def test_fence_and_safe(spark, raw, clean, safe):
    assert one(spark, tx.clean_json_fence("t"), t=raw) == clean
    assert one(spark, tx.safe_json("t"), t=raw) == safe


@pytest.mark.parametrize("raw,first,block", [('a {"b":{"c":1}} {"d":2}', '{"b":{"c":1}}', '{"b":{"c":1}}'), ('x ```json\n{"q":1}\n``` {"z":0}', '{"q":1}', '{"q":1}'), ('{"a":"}"}', '{"a":"}', None), ("{", None, None), ("none", None, None), (None, None, None)])
def test_objects(spark, raw, first, block):
    assert one(spark, tx.first_json_object("t"), t=raw) == first
    assert one(spark, tx.extract_json_block("t"), t=raw) == block


@pytest.mark.parametrize("raw,want", [(None, []), ("E1", ["E1"]), ('["E1",null,"E2"]', ["E1", "E2"]), ("[broken", ["[broken"]), ("", [""])])
def test_ensure_list(spark, raw, want):
    assert one(spark, tx.ensure_list("t"), t=raw) == want


@pytest.mark.parametrize("raw,want", [('{"a":1,"b":null,"a":true}', {"a": "true", "b": None}), ("{}", {}), ('{"a":', {}), ("", {}), (None, {}), ("[1]", {})])
def test_props(spark, raw, want):
    assert one(spark, tx.json_props("t"), t=raw) == want


@pytest.mark.parametrize(
    "head,rel,tail,want",
    [
        ('{"id":"E1","type":"人物","職稱":"處長","x":null}', '{"evidence":"甲","date":"","time":"2024"}', "{}", "1. H（type:人物；職稱:處長） 透過關係【R】與 T（受體） 建立連結，說明：甲；事件時間：2024。"),
        (None, '{"evidence":null}', '{"name":"n"}', "1. H（主體） 透過關係【R】與 T（受體） 建立連結，說明：。"),
        ("", "", '{"k":["a"]}', '1. H（主體） 透過關係【R】與 T（k:["a"]） 建立連結，說明：R。'),
    ],
)
def test_verbalise(spark, head, rel, tail, want):
    said = tx.verbalise(F.lit("H"), F.lit("R"), F.lit("T"), tx.json_props("h"), tx.json_props("r"), tx.json_props("t"))
    assert one(spark, said, h=head, r=rel, t=tail) == want


def test_lines_keys_numbers(spark):
    assert one(spark, tx.split_lines("t"), t="a\r\nb \nc\n") == ["a", "b", "", "c"]
    assert one(spark, tx.split_lines("t"), t="") == []
    line = "1. 甲（type:人物） 透過關係【x】"
    assert one(spark, tx.entity_key_full("t"), t=line) == "甲（type:人物）" and one(spark, tx.entity_key_name("t"), t=line) == "甲"
    assert one(spark, tx.entity_key_full("t"), t="no number") == "no" and one(spark, tx.entity_key_name("t"), t="  ") == ""
    assert one(spark, tx.renumber_bracket("t", F.lit(7)), t="1. x") == "[7] x" and one(spark, tx.renumber_bracket("t", F.lit(7)), t="x 1.") == "x 1."
    assert one(spark, tx.renumber_prefix("t", F.lit(7)), t="[3]. x") == "[7] x" and one(spark, tx.renumber_prefix("t", F.lit(7)), t="x") == "[7] x"
    assert one(spark, tx.triple_text("a", "b", "c"), a="x", b=None, c="z") == "x  z"


@pytest.mark.parametrize("raw,want", [("2024/1/5", "2024-01-05"), ("2024/02/30", None), ("24/1/5", None), ("2024-01-05", None), (None, None)])
def test_request_date(spark, raw, want):
    assert one(spark, tx.request_date("t").cast("string"), t=raw) == want


def test_requests_and_labels(spark):
    status = lambda t, d, link: one(spark, tx.request_status("t", "d", F.lit(link)), t=t, d=d)
    assert [status("", "", True), status("a", None, True), status("a", "d", True), status("http://a.b", "d", True), status("a", "d", False)] == ["NO_TEXT", "NO_DATE", "NO_URL", "OK", "OK"]
    label = lambda n, flag, c: one(spark, tx.parse_label(F.lit(n).cast("int"), F.col("f"), F.col("c")), f=flag, c=c)
    assert [label(3, "no", "x"), label(None, " YES ", "x"), label(None, "0", "Fake_News"), label(None, None, "Fake_News"), label(None, None, None)] == [3, 1, 0, 1, 0]
    assert one(spark, tx.run_id("d", F.lit("2024-12-31 17:05:00").cast("timestamp_ntz")), d="2024-12-12") == "2024-12-12_2025-01-01_0105"
    assert one(spark, tx.id_from_path("p"), p="/a/b/news_kg_x.txt.txt") == "x"
