import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import neardup
from factloom.llm.neardup import groups, near_duplicates, plain, record_pairs


def shingles(text):
    t = plain(text) or ""
    return {t[i : i + 3] for i in range(len(t) - 2)}


def brute(data, least):
    sets = {r: shingles(t) for r, t in data}
    ids = sorted(r for r, s in sets.items() if s)
    return sorted((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh中文字樣", k=rng.randint(1, 4))) for _ in range(40)]
    base = [rng.choices(words, k=rng.randint(1, 30)) for _ in range(60)]
    out = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(words))
            w.pop(rng.randrange(len(w)))
        out.append((i, " ".join(w)))
    return out + [(1000, None), (1001, ""), (1002, "ab"), (1003, "ＡＢＣ"), (1004, "a-b c!"), (1005, "長文" * 20_000), (1006, "長文" * 20_000 + "x"), (1007, "aaaa"), (1008, "aaa")]


@pytest.mark.parametrize("method", ["prefix", "partition"])
@pytest.mark.parametrize("least", [0.6, 0.8])
def test_exact(spark, rows, method, least):
    data = corpus(1)
    df = spark.createDataFrame([(r, t, 0) for r, t in data], "rec bigint, evidence string, rep int")
    members, classes = neardup.text_classes(df, "rec", "evidence")
    assert rows(record_pairs(members, neardup.similar_classes(classes, least, method))) == sorted(brute(data, least), key=str)


def test_hot_tokens_are_split(spark, rows, monkeypatch):
    data = corpus(2)
    df = spark.createDataFrame(data, "rec bigint, evidence string")
    members, classes = neardup.text_classes(df, "rec", "evidence")
    real = neardup._prefix_rows

    def small(*args):
        old, neardup.HOT = neardup.HOT, 5
        try:
            return real(*args)
        finally:
            neardup.HOT = old

    monkeypatch.setattr(neardup, "_prefix_rows", small)
    assert rows(record_pairs(members, neardup.similar_classes(classes, 0.6))) == sorted(brute(data, 0.6), key=str)


def test_sets_too_long_for_the_order_of_sizes():
    common, rarer = "".join(map(chr, range(0x20000, 0x20000 + 20_002))), "".join(map(chr, range(0x30000, 0x30000 + 12_000)))
    freq = np.ones(neardup.CELLS, np.float32)
    freq[(neardup._mix(neardup.windows([common]), 0x51ED) & np.uint64(neardup.CELLS - 1)).astype(np.int64)] = 9
    for ids, texts in (([1, 2], [common, rarer + common]), ([2, 1], [rarer + common, common])):  # within a key both come first at times
        packed = neardup._prefix_rows(np.array(ids), texts, 0.6, freq, 1)
        assert {(p["a"], p["b"]) for out in neardup._pair_part([packed], 0.6) for p in out.to_pylist()} == {(1, 2)}
    assert list(neardup._pair_part([], 0.6)) == []


def test_groups(spark, rows):
    text = "one two three four five six seven"
    data = [(5, text), (3, text), (9, text + " eight"), (7, "quite another thing altogether"), (8, None)]
    members, links = near_duplicates(spark.createDataFrame(data, "rec bigint, evidence string"), "rec", "evidence")
    assert rows(groups(members, links)) == [(3, 3, 3, 1), (5, 3, 3, 1), (7, 7, 7, 0), (9, 9, 3, 1)]
    empty = spark.createDataFrame([], "rec bigint, evidence string")
    members, links = near_duplicates(empty, "rec", "evidence")
    assert rows(record_pairs(members, links)) == [] and rows(groups(members, links)) == []
