import os

import pytest
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.mixing import budgets, by_levels, mix, plan, shares

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no tokenizer files here")
NAME = "byte_bpe_50k"
TEXTS = [None, "", " ", "Hello  world's <|endoftext|> it's", "中文，標點。ＡＢ１２３\r\n\t x", "é é 👩‍👧 　a b", "𱍐𮯰 ꟺ 12345 don't", "a" * 30_000, "word " * 20_000, "  \n\n "]


def expected(text):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=tokens.ranks(NAME), special_tokens={}).encode_ordinary(text or "")


def docs(spark):
    return spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int, _doc string")


def test_ids_equal_the_library(spark):
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs(spark), "doc_id", "text", NAME).collect()}
    assert got == {i: expected(t) for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(docs(spark).limit(0), "doc_id", "text", NAME).count() == 0


def test_small_bundles_encode_each_word_once(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BUNDLE", 3)
    monkeypatch.setattr(tokens, "STEP", 4)
    short = docs(spark).where("length(text) < 100").unionByName(docs(spark).where("doc_id < 6")).repartition(3)
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_corpus(short, "doc_id", "text", NAME).collect()]
    assert len(got) == 13 and all(ids == expected(TEXTS[i]) for i, ids in got)
    bundles, parts = tokens.word_lists(short, ["doc_id"], "text")
    assert bundles.where("part < 0").count() > 3
    once = tokens.encoded_lists(bundles, parts, NAME).agg({"fresh": "sum"}).head()[0]
    assert once == short.select(F.explode(tokens.words(F.col("text")))).distinct().count()


def test_round_trip_and_counts(spark):
    encoded = tokens.encode_corpus(docs(spark), "doc_id", "text", NAME)
    assert {r["doc_id"]: r["text"] for r in tokens.decode_corpus(encoded, "doc_id", "ids", NAME).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs(spark), ["doc_id"], "text", NAME).collect()}
    assert counts == {i: len(expected(t)) for i, t in enumerate(TEXTS)}


def test_decoding_edges(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [15496, None, 60000, -5, 995]), (4, [15496])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokens.decode_corpus(df, "doc_id", "ids", NAME).collect()} == {1: "", 2: "", 3: "Hello world", 4: "Hello"}
    assert tokens.decode_corpus(df.limit(0), "doc_id", "ids", NAME).count() == 0


def leaf(name, path, weight, capacity):
    return {"name": name, "path": path, "weight": weight, "capacity": capacity}


def test_budgets_go_to_siblings_before_ancestors():
    tree = [leaf("a", ("d1", "en", "a"), 0.25, 10), leaf("b", ("d1", "en", "b"), 0.25, 100), leaf("c", ("d1", "zh", "c"), 0.25, 100), leaf("d", ("d2", "zh", "d"), 0.25, 100)]
    assert budgets(tree, 100) == {"a": 10, "b": 40, "c": 25, "d": 25}
    tree[1]["capacity"] = 20
    assert budgets(tree, 100) == {"a": 10, "b": 20, "c": 45, "d": 25}
    assert sum(budgets(tree, 1000).values()) == 230
    assert budgets([], 5) == {} and budgets([leaf("z", ("z",), 0.0, 5)], 5) == {"z": 0}


def sizes(spark):
    data = [(i, "s", 10) for i in range(100)] + [(1000 + i, "t", 7) for i in range(30)] + [(2000, None, 5), (2001, "u", 5), (2002, "s", 0)]
    return spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")


def targets(spark):
    return spark.createDataFrame([("s", 0.5, 1), ("t", 0.4, 3), ("v", 0.1, 5)], "source string, target_share double, max_repeats int")


def test_mixture(spark):
    p = plan(sizes(spark), targets(spark), total=800.0)
    rows = {r["source"]: r.asDict() for r in p.collect()}
    assert rows["v"]["tokens"] == 0 and not rows["v"]["reachable"] and rows["s"]["reachable"] and rows["t"]["reachable"]
    assert round(rows["s"]["budget"] + rows["t"]["budget"], 6) == 800
    used = mix(sizes(spark), p, "doc_id").collect()
    assert used == mix(sizes(spark), p, "doc_id").collect() or sorted(used) == sorted(mix(sizes(spark), p, "doc_id").collect())
    per = {}
    for r in used:
        per.setdefault((r["doc_id"], r["source"]), []).append(r["epoch"])
    assert all(len(e) == len(set(e)) <= {"s": 1, "t": 3}[k[1]] for k, e in per.items())
    total = {s: sum(r["n_tokens"] for r in used if r["source"] == s) for s in "st"}
    assert all(rows[s]["budget"] - 10 < total[s] <= rows[s]["budget"] for s in "st")
    got = {r["source"]: r for r in shares(mix(sizes(spark), p, "doc_id"), p).collect()}
    assert got["v"]["actual_share"] == 0 and abs(got["s"]["actual_share"] + got["t"]["actual_share"] - 1) < 1e-9


def test_plan_through_levels(spark):
    docs = [(1, "a", 10), (2, "b", 100), (3, "c", 100), (4, "d", 100)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    rows = [("a", 0.25, 1, "d1", "en"), ("b", 0.25, 1, "d1", "en"), ("c", 0.25, 1, "d1", "zh"), ("d", 0.25, 1, "d2", "zh")]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, domain string, lang string")
    budget = lambda **more: {r["source"]: round(r["budget"], 6) for r in plan(sizes, targets, total=100.0, **more).collect()}
    assert budget(levels=["domain", "lang"]) == {"a": 10, "b": 40, "c": 25, "d": 25}  # to the sibling only
    assert budget() == {"a": 10, "b": 30, "c": 30, "d": 30}  # one level: to all others


def test_leaves_of_levels(spark):
    docs = [(1, "a", "en", 10), (2, "a", "zh", 30), (3, "b", "en", 100), (4, "b", None, 100), (5, "c", "zh", 5), (6, None, "zh", 5)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, n_tokens bigint")
    wanted = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    leaves, targets = by_levels(sizes, wanted, ["lang"])
    planned = plan(leaves, targets, total=200.0, levels=["lang"])
    got = {r["source"]: (r["tokens"], round(r["wanted"], 6), round(r["budget"], 6)) for r in planned.collect()}
    assert got == {"en/a": (10, 25.0, 10.0), "zh/a": (30, 75.0, 30.0), "en/b": (100, 50.0, 92.0), "/b": (100, 50.0, 68.0)}  # what en/a lacks goes to en/b only
    assert {r["source"] for r in mix(leaves, planned, "doc_id").collect()} == {"en/a", "zh/a"}  # no document of b fits its budget


def test_mixture_of_nothing(spark):
    p = plan(sizes(spark).limit(0), targets(spark))
    assert {r["reachable"] for r in p.collect()} == {True} and mix(sizes(spark).limit(0), p, "doc_id").count() == 0
    assert shares(mix(sizes(spark).limit(0), p, "doc_id"), p).count() == 3
