import pytest

from factloom.llm.looks import evidence, fold, fold_all, one_form, same_look_pairs, substituted

PAIRS = [("ＡＢ１", "AB1"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("ﬁne", "fine"), ("⼈", "人"), ("金", "金"), ("x‑y", "x-y"), ("a\r\nb", "a\nb"), ("﻿a", "a"), ("a　b", "a b"), ("ｶﾞ", "ガ")]
DIFFERENT = [("A", "a"), ("a  b", "a b"), ("國", "国"), ("👩‍👧", "👩👧"), ("²", "2"), ("①", "1")]


@pytest.mark.parametrize("a,b", PAIRS)
def test_same(a, b):
    assert fold(a) == fold(b) and fold_all([a, None, b]) == [fold(a), None, fold(b)]


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_not_same(a, b):
    assert fold(a) != fold(b) and fold_all([a, b]) == [fold(a), fold(b)]


def test_tokens():
    assert substituted("Nоrth") == "North" and substituted("North") is None
    assert substituted("деревня") is None and substituted("Κρήτη") is None
    assert substituted("дерeвня") == "деревня" and substituted("Mосква") == "Москва" and substituted("Kρήτη") == "Κρήτη"  # towards the dominant script
    assert substituted("сор") == substituted("сор", evidence("the north wind")) == "cop" and substituted("сор", evidence("деревня жила")) is None
    assert substituted("naїve") == substituted("naїve") == "naïve"  # a mark on a look-alike
    assert substituted("𝐍orth") == "North" and substituted("Ⅹmas") == "Xmas" and substituted("ⅠⅩ́") == "IX́" and substituted("ℵ") is None
    assert fold_all([]) == [] and fold_all(["\U0010ffff", "ＡＡ"]) == ["\U0010ffff", "AA"]


def test_forms_and_pairs(spark, rows):
    texts = {1: "the North wind", 2: "the Nоrth wind", 3: "the Nоrth​ wind", 4: "the North wind", 5: None, 6: "", 7: " ​", 8: "　", 9: "Wоrdx", 10: "Wоrdх", 11: "алоне оса", 12: "Ünіque", 13: "x" * 50_000 + " y", 14: "x" * 50_000 + " y"}
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in texts.items()], "doc_id bigint, text string, form string, _doc int")
    forms = {r["doc_id"]: (r["form"], r["repaired"]) for r in one_form(df, "doc_id", "text").collect()}
    assert forms[1] == forms[4] == ("the North wind", 0) and forms[2] == forms[3] == ("the North wind", 1)
    assert forms[5] == (None, 0) and forms[6] == ("", 0)
    assert forms[9] == forms[10] == ("Wordx", 1)  # the result is there only as two disguises
    assert forms[12] == ("Ünіque", 0)  # nobody writes the result
    assert rows(same_look_pairs(df, "doc_id", "text")) == [(1, 2), (1, 3), (13, 14), (2, 3), (2, 4), (3, 4), (9, 10)]
    assert same_look_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_cyrillic_texts_keep_their_words(spark):
    texts = {1: "cop", 2: "деревня сор", 3: "деревня copт", 4: "деревня сорт", 5: "\u180bcop\U000e0101"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    forms = {r["doc_id"]: r["form"] for r in one_form(df, "doc_id", "text").collect()}
    assert forms == {1: "cop", 2: "деревня сор", 3: "деревня сорт", 4: "деревня сорт", 5: "cop"}


def test_many_copies_are_paired_by_class(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id = 7, 'the \u039dorth wind', 'the North wind') as text")
    pairs = same_look_pairs(df, "doc_id", "text")
    assert pairs.count() == pairs.distinct().count() == 19_999
