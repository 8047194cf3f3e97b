import glob
import json
import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factloom import session
from factloom.functions import text as tx
from factloom.functions import vectors as vf
from factloom.operators import dedup, graph, report, triples, vectors
from factloom.plans import pipelines
from factloom.providers import HashingEncoder, ReplayAnswers, TableEncoder, with_retry
from factloom.sources import files
from factloom.streaming import inbox


def test_vector_functions(spark, rows):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "i int, v array<float>")
    assert rows(df.select("i", vf.unit(df["v"]))) == [(1, [0.6, 0.8]), (2, None), (3, None), (4, None)]
    assert rows(df.select("i", vf.cosine(df["v"], df["v"]))) == [(1, 1.0), (2, None), (3, None), (4, None)]


def test_exact_top_k_ties_blocks_and_empty(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_NUMBERS", 2)
    monkeypatch.setattr(vectors, "TILE", 2)
    monkeypatch.setattr(vectors, "WAITING", 1)
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0]), (5, None), (6, [-1.0, 0.0])], "r_id bigint, vec array<float>")
    q = data.where("r_id in (1, 3)").withColumnRenamed("r_id", "q_id")
    got = rows(vectors.exact_top_k(q, data, 2).selectExpr("q_id", "r_id", "round(sim, 6)", "rank"))
    assert got == [(1, 1, 1.0, 2), (1, 2, 1.0, 1), (3, 2, 0.6, 2), (3, 3, 1.0, 1)]
    assert rows(vectors.exact_top_k(q, data, 5, least=0.9), "q_id", "r_id") == [(1, 1), (1, 2), (3, 3)]
    assert rows(vectors.exact_top_k(q, data.limit(0), 2)) == rows(vectors.exact_top_k(q.limit(0), data, 2)) == []


def test_pool_and_chunks(spark, rows):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", None)], "k string, v array<float>")
    assert rows(vectors.mean_pool(df, "k", "v")) == [("a", [2.0, 3.0])]
    docs = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 510, 511, 766, 767, 1022)] + [(9, None)], "n int, t string")
    counts = {}
    for n, no, start, chunk in rows(vectors.sliding_chunks(docs, "n", "t")):
        counts[n] = counts.get(n, 0) + 1
        assert start == no * 256 and len(chunk) == min(510, n - start)
    assert counts == {n: 1 if n <= 510 else math.ceil((n - 510) / 256) + 1 for n in (1, 510, 511, 766, 767, 1022)}


ANSWER = {
    "entities": [{"id": "E1", "name": "A", "attributes": {"k": "v", "type": "X"}}, {"id": "E2", "name": "B", "type": "T", "attributes": '{"z": 1}'}, {"id": "E2", "name": "C", "attributes": None}],
    "relations": [{"source": "E1", "relation": "r", "target": ["E2", "E9"], "evidence": "e"}, {"source": "E1", "target": "E2"}, {"source": None, "relation": "r", "target": "E2"}, {"source": "E1", "relation": "r", "target": "E2", "evidence": ""}],
}


def test_graph_from_answers(spark, rows):
    df = spark.createDataFrame([(1, json.dumps(ANSWER)), (1, json.dumps(ANSWER)), (2, None), (3, "{}"), (4, '{"entities":[')], "d int, payload string")
    read = graph.read_results(df, ["d"])
    assert rows(graph.entity_nodes(read, ["d"]), "id", "name", "type", "props") == [("E1", "A", "X", {"k": "v"}), ("E2", "B", "T", {"z": "1"}), ("E2", "C", "Entity", {})]
    edges = rows(graph.relation_edges(read, ["d"]), "pos", "source_name", "relation", "target_name", "evidence")
    assert edges == [(0, "A", "r", "", "e"), (0, "A", "r", "C", "e"), (1, "A", "RELATED_TO", "C", ""), (3, "A", "r", "C", "")]
    assert rows(graph.resolve_triples(read, ["d"]), "pos", "head", "relation", "tail") == [(3, "A", "r", "C")]
    assert rows(graph.relation_edges(graph.read_results(df.limit(0), ["d"]), ["d"])) == []


def test_upsert_and_load(spark, rows):
    schema = "name string, id string, type string, props map<string,string>, seq int"
    old = spark.createDataFrame([("a", "1", "T", {"x": "1", "y": "2"}, 1), ("b", None, None, None, 2), (None, "9", "T", {}, 3)], schema)
    new = spark.createDataFrame([("a", "7", "U", {"x": None, "z": "3"}, 1), ("a", "8", "U", {"y": "5"}, 2), ("c", "3", "T", {}, 3)], schema)
    assert rows(graph.node_upsert(old, new)) == [("a", "1", "T", {"y": "5", "z": "3"}), ("b", None, None, {}), ("c", "3", "T", {})]
    e = "i int, source_name string, target_name string, relation string, evidence string"
    have = spark.createDataFrame([(0, "a", "b", "r", "old")], e)
    log = spark.createDataFrame([(1, "a", "b", "r", "old"), (2, "a", "b", "q", "new"), (3, "a", "b", "r", "new"), (4, "a", "z", "r", "new"), (5, "a", "b", "", "n2"), (6, "a", "b", "r", "n2"), (7, "a", None, "r", "n3"), (8, "a", "b", "r", "")], e)
    assert rows(graph.edge_load(have, log, old, "i"), "i") == [(2,), (6,)]


def test_merge_and_question_triples(spark, rows):
    t = spark.createDataFrame([("d", 2, 0, "a", "r", "b"), ("d", 1, 1, "c", "r", "d"), ("d", 1, 0, "a", "r", "b")], "doc string, round int, pos int, head string, relation string, tail string")
    assert rows(triples.merge_triples(t, "doc", ["round", "pos"]), "head", "seq") == [("a", 1), ("c", 2)]
    q = spark.createDataFrame([(1, '{"triples":[{"subject":"s","relation":"r"},{"subject":"","relation":"r"},{"subject":"s","relation":"r","object":"o"}]}'), (2, None), (3, "[]")], "i int, a string")
    assert rows(triples.question_triples(q, ["i"], "a"), "pos", "tail") == [(0, "未知"), (2, "o")]
    listed = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", None, "c"]), (3, ["a"]), (4, None)], "i int, l array<string>")
    assert rows(triples.normalise_listed(listed, ["i"], "l")) == [(1, "a", "b", "c")]


def naive_first(lines, least):
    kept = []
    for seq, line, v in lines:
        if not any(cos(v, w) >= least for _, _, w in kept):
            kept.append((seq, line, v))
    return [(s, line) for s, line, _ in kept]


def naive_longest(lines, least):
    slots = []
    for seq, line, v in lines:
        for slot in slots:
            if cos(v, slot[2]) >= least:
                if len(line) > len(slot[1]):
                    slot[1:] = [line, v]
                break
        else:
            slots.append([seq, line, v])
    return [(s, line) for s, line, _ in slots]


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else -2


LINES = st.lists(st.tuples(st.sampled_from(["a", "bb", "ccc", "dddd"]), st.lists(st.integers(-2, 2).map(float), min_size=3, max_size=3)), min_size=1, max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LINES)
def test_dedup_folds_equal_loops(spark, lines):
    numbered = [(i, t, v) for i, (t, v) in enumerate(lines)]
    df = spark.createDataFrame([("d", "b", *x) for x in numbered], "doc string, bucket string, seq int, line string, vec array<float>")
    for ours, naive in ((dedup.keep_first, naive_first), (dedup.keep_longest, naive_longest)):
        got = sorted((r["seq"], r["line"]) for r in ours(df, ["doc", "bucket"], 0.7).collect())
        assert got == sorted(naive(numbered, 0.7))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINES, min_size=1, max_size=4))
def test_folds_by_id_equal_loops_and_send_each_line_once(spark, monkeypatch, docs):
    known = sorted({(t, tuple(v)) for lines in docs for t, v in lines})
    lines = spark.createDataFrame([(i, 7, len(t), list(v)) for i, (t, v) in enumerate(known)], "line_id bigint, b bigint, n_chars int, vec array<float>")
    placed = spark.createDataFrame([(d, i, 7, known.index((t, tuple(v)))) for d, x in enumerate(docs) for i, (t, v) in enumerate(x)], "d bigint, seq bigint, b bigint, line_id bigint")
    for size in (1 << 16, 2):  # the second: the bucket is parted by document
        monkeypatch.setattr(dedup, "FOLDED", size)
        for longest, naive in ((False, naive_first), (True, naive_longest)):
            got = sorted((r["d"], r["seq"], known[r["line_id"]][0]) for r in dedup.fold_ids(placed, lines, 0.7, longest).collect())
            assert got == sorted((d, *x) for d, lines_ in enumerate(docs) for x in naive([(i, t, v) for i, (t, v) in enumerate(lines_)], 0.7))


def test_packed_reports_equal_assembled(spark, rows, monkeypatch):
    monkeypatch.setattr(report, "PACKED", 1)  # a block for each batch
    docs = spark.createDataFrame([(1, "x", "one"), (1, "x", "two"), (2, "y", None), (3, "z", "three")], "d bigint, doc string, text string")
    told = spark.createDataFrame([(d, n, (n + d) % 3 > 0, f". same{n % 5}") for d in (1, 2, 3) for n in range(1, 30)], "d bigint, n int, numbered boolean, text string")
    lines = told.selectExpr("d", "n", "if(numbered, concat('[', n, ']', text), text) text").join(docs.select("d", "doc").distinct(), "d")
    assert rows(report.packed_reports(docs, told, "doc", 2)) == rows(report.assemble(docs, lines, "doc"))
    assert report.packed_reports(docs.limit(0), told.limit(0), "doc", 2).count() == 0


def test_settled_deletes_what_it_was_made_from(spark):
    made = session.settled(lambda: session.written(spark.range(3), "inner").selectExpr("id + 1 AS id"), "outer")
    left = [os.path.basename(p) for p in glob.glob(session.shared_folder(spark).removeprefix("file://") + "/factloom-*")]
    assert sorted(r["id"] for r in made.collect()) == [1, 2, 3] and any("-outer-" in p for p in left) and not any("-inner-" in p for p in left)
    session.discard(made)
    assert not any("-outer-" in p for p in glob.glob(session.shared_folder(spark).removeprefix("file://") + "/factloom-*"))
    again = spark.range(8).repartition(2)
    assert session.written(again.groupBy("id").count(), "once").count() == again.count() == 8


def test_report_and_status(spark, rows):
    lines = spark.createDataFrame([("d", "b", 2, "1. y", [1.0]), ("d", "b", 1, "1. x", [0.5])], "doc string, bucket string, seq int, line string, vec array<float>")
    numbered = dedup.renumber(lines, "doc", ["seq"])
    docs = spark.createDataFrame([("d", "text"), ("e", "other"), ("f", None)], "doc string, text string")
    assert rows(report.assemble(docs, numbered.select("doc", "n", "text"), "doc")) == [("d", "```\n[原始新聞]\ntext\n```\n```\n[比對知識]\n[1] x\n[2] y\n```")]
    assert rows(report.status(docs, docs.where("doc <> 'f'"), lines, "doc")) == [("d", "OK"), ("e", "NO_HITS"), ("f", "NO_TRIPLES")]


KG = "r_id bigint, head string, relation string, tail string, head_props string, rel_props string, tail_props string"


def test_pipelines_end_to_end(spark):
    kg = spark.createDataFrame([(1, "A", "r", "C", '{"type":"t"}', '{"evidence":"one\\ntwo","date":"2024"}', None), (2, "X", "q", "Y", None, None, None)], KG)
    encoder = HashingEncoder()
    vec = encoder.encode(kg.selectExpr("r_id", "concat_ws(' ', head, relation, tail) t"), "t").select("r_id", "vec")
    docs = spark.createDataFrame([("d", "news"), ("n", "nothing"), ("h", "no hit")], "doc_id string, text string")
    far = {"entities": [{"id": "1", "name": "QQQ"}, {"id": "2", "name": "WWW"}], "relations": [{"source": "1", "relation": "zzz", "target": "2"}]}
    raw = spark.createDataFrame([("d", 1, "```json\n" + json.dumps(ANSWER) + "\n```"), ("d", 2, json.dumps(ANSWER)), ("n", 1, "sorry"), ("h", 1, json.dumps(far))], "doc_id string, round_no int, raw string")
    got = {r["doc_id"]: (r["status"], r["report"]) for r in pipelines.verify(docs, ReplayAnswers(raw), encoder, kg, vec).collect()}
    assert got["n"] == ("NO_TRIPLES", None) and got["h"] == ("NO_HITS", None)
    assert got["d"][0] == "OK" and "[1] A（type:t） 透過關係【r】與 C（受體） 建立連結，說明：one\ntwo；事件時間：2024。" in got["d"][1]
    asked = spark.createDataFrame([("d", 1, '{"triples":[{"subject":"A","relation":"r","object":"C"}]}')], "doc_id string, round_no int, raw string")
    got = {r["doc_id"]: (r["status"], r["report"]) for r in pipelines.answer(docs, ReplayAnswers(asked), encoder, kg, vec, same=0.99).collect()}
    assert got["d"][0] == "OK" and "[知識查詢結果]\n[1] A" in got["d"][1]
    linked = spark.createDataFrame([("d", 1, json.dumps(ANSWER)), ("d", 2, '{"triples":[{"subject":"A","relation":"r"}]}'), ("d", 3, ""), ("d", 4, "no")], "doc_id string, round_no int, raw string")
    assert [(r["head"], r["tail"]) for r in pipelines.asked_triples(docs, ReplayAnswers(linked)).orderBy("seq").collect()][-1] == ("A", "未知")
    got = {r["doc_id"]: r["status"] for r in pipelines.answer(docs, ReplayAnswers(linked), encoder, kg, vec).collect()}
    assert got["d"] == "OK" and got["n"] == "NO_TRIPLES"
    assert sorted((r["round_no"], r["reason"]) for r in pipelines.read_rounds(docs, ReplayAnswers(linked))[1].collect()) == [(3, "EMPTY"), (4, "NOT_JSON")]


def test_verdicts(spark, rows):
    raw = "```\n一、明細\n1. 前\n✅ 一致\n1. 甲[1][3]\n⚠️ 缺漏\n1. 乙[2]\n12. 丙\n二、總結\n1. 無\n三、評分\n11分 7分\n```"
    reports = spark.createDataFrame([("a", "```\n[比對知識]\n[1] x\n[2] y\n```"), ("b", "r"), ("c", None)], "doc_id string, report string")
    judged = spark.createDataFrame([("a", 1, raw), ("b", 1, "nothing"), ("b", 2, None), ("c", 1, raw)], "doc_id string, round_no int, raw string")
    scores, points = pipelines.judge(reports, ReplayAnswers(judged))
    assert rows(scores, "doc_id", "round_no", "score") == [("a", 1, 7), ("b", 1, None), ("b", 2, None)]
    assert rows(points) == [("a", 1, "consistent", 1, "甲[1][3]", [1]), ("a", 1, "missing", 2, "乙[2]", [2]), ("a", 1, "missing", 3, "丙", [])]


def test_folds_without_direction(spark):
    lines = [("d", "b", 1, "x", None), ("d", "b", 2, "x", [0.0, 0.0]), ("d", "b", 3, "yy", [1.0, 0.0]), ("d", "b", 4, "zzz", [1.0, 0.1]), ("d", None, 5, None, [1.0, 0.0]), ("d", None, 6, "q", [1.0, 0.0])]
    df = spark.createDataFrame(lines, "doc string, bucket string, seq int, line string, vec array<float>")
    assert sorted(r["seq"] for r in dedup.keep_first(df, ["doc", "bucket"], 0.9).collect()) == [1, 2, 3, 5]
    assert sorted((r["seq"], r["line"]) for r in dedup.keep_longest(df, ["doc", "bucket"], 0.9).collect()) == [(1, "x"), (2, "x"), (3, "zzz"), (5, "q")]
    assert dedup.keep_first(df.limit(0), ["doc", "bucket"]).count() == dedup.keep_longest(df.limit(0), ["doc", "bucket"]).count() == 0


def test_token_windows(spark, rows):
    texts = [(1, "中文ab  cd "), (2, " ".join(map(str, range(1023)))), (3, ""), (4, None), (5, "字" * 511)]
    got = {}
    for n, no, size, chunk in rows(vectors.token_chunks(spark.createDataFrame(texts, "n int, t string"), "n", "t")):
        got.setdefault(n, []).append((no, size, chunk))
    assert got[1] == [(0, 5, "中文ab  cd ")] and set(got) == {1, 2, 5}
    assert [(no, size) for no, size, _ in sorted(got[2])] == [(0, 510), (1, 510), (2, 510), (3, 255)] and got[5] == [(0, 510, "字" * 510), (1, 255, "字" * 255)]


def test_build_graph(spark, rows):
    nodes = spark.createDataFrame([("A", "0", "old", {"k": "0"})], "name string, id string, type string, props map<string,string>")
    edges = spark.createDataFrame([], "source_name string, target_name string, evidence string")
    answers = spark.createDataFrame([("d", 1, json.dumps(ANSWER))], "doc_id string, seq bigint, payload string")
    merged, new = pipelines.build_graph(answers, nodes, edges)
    assert rows(merged, "name", "id", "type") == [("A", "0", "old"), ("B", "E2", "T"), ("C", "E2", "Entity")]
    assert rows(new, "source_name", "target_name", "evidence", "doc_id", "date") == [("A", "C", "e", "d", None)]
    two = "see {\"a\": 1} and\n```json\n" + json.dumps(ANSWER) + "\n```\n{not json}"
    _, new = pipelines.build_graph(spark.createDataFrame([("d", 1, two)], "doc_id string, seq bigint, payload string"), nodes, edges)
    assert rows(new, "source_name", "evidence") == [("A", "e")]
    dated = {**ANSWER, "relations": [{**ANSWER["relations"][0], "evidence": "f", "attributes": {"date": "2024-01-02", "doc_id": "x", "relation": "last", "place": {"a": 1}}}]}
    _, new = pipelines.build_graph(spark.createDataFrame([("d", 1, json.dumps(dated))], "doc_id string, seq bigint, payload string"), nodes, edges)
    assert set(rows(new, "evidence", "relation", "doc_id", "date")) == {("f", "last", "x", "2024-01-02")}


def test_files_round_trip(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_bytes("﻿ 新聞 \n".encode())
    (tmp_path / "in" / "a.txt").write_bytes(b"ok\xff")
    (tmp_path / "in" / "c.md").write_text("no")
    docs = files.read_documents(spark, str(tmp_path / "in"))
    assert rows(docs) == [("a", "a.txt", "ok"), ("b", "b.txt", "新聞")]
    assert rows(files.pending(docs, docs.where("doc_id = 'a'")), "doc_id") == [("b",)]
    df = spark.createDataFrame([("h", "r", 'say "x",\nline', '{"a":"b"}', None, "{}"), ("", "r", None, None, None, None)], "head string, relation string, tail string, head_props string, rel_props string, tail_props string")
    assert files.write_triples(df, str(tmp_path / "t")) == 2
    assert files.read_triples(spark, str(tmp_path / "t")).where("relation = 'r'").count() == 2
    assert rows(files.read_triples(spark, str(tmp_path / "t")).where("head = 'h'"))[0] == ("h", "r", 'say "x",\nline', '{"a":"b"}', None, "{}")
    assert rows(spark.createDataFrame([(bytearray("a\ufffdb".encode() + b"\xff"),), (bytearray("\ufffd".encode()),)], "c binary").select(files.decode_upload("c"))) == [("a\ufffdb",), ("\ufffd",)]
    for run, text in (("1", "old"), ("2", "two"), ("1", "new")):
        files.write_reports(spark.createDataFrame([("d", text)], "doc_id string, report string"), str(tmp_path / "r"), run)
    assert rows(spark.read.parquet(str(tmp_path / "r")), "report", "run_id") == [("new", 1), ("two", 2)]
    paths = spark.createDataFrame([("/x/y/a.txt", "1"), ("/in/a.txt", "2"), ("a.txt/z", "3")], "path string, text string")
    assert files.resolve_document(paths, "a.txt", "/in").first()["text"] == "2"


def test_stream_handles_each_file_once(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    box.mkdir()
    (box / "one.txt").write_text("﻿first\nsecond")
    for _ in range(2):
        inbox.drain(inbox.read_inbox(spark, str(box)), str(tmp_path / "cp"), lambda df: df, out)
    (box / "two.txt").write_text("later")
    inbox.drain(inbox.read_inbox(spark, str(box)), str(tmp_path / "cp"), lambda df: df, out)
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(out).collect()) == [("one", "first\nsecond"), ("two", "later")]


def test_providers(spark, rows):
    waits = []
    calls = iter([ValueError(), ValueError(), 5])

    def flaky():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert with_retry(flaky, sleep=waits.append)() == 5 and waits == [5.0, 10.0]
    texts = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    known = spark.createDataFrame([("ab", [1.0])], "text string, vec array<float>")
    assert rows(TableEncoder(known).encode(texts, "t"), "vec") == [(None,), (None,), ([1.0],)]
    assert [r["vec"] is None for r in HashingEncoder(8).encode(texts, "t").collect()].count(True) == 2


def test_written_tables_can_be_cleared(spark):
    session.clear_written(spark)
    df = session.written(spark.range(3), "test")
    assert df.count() == 3 and session.clear_written(spark) == 1 and session.clear_written(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        Fake.sparkContext = type("Context", (), {"master": master})
        with pytest.raises(ValueError):
            session.shared_folder(Fake)


def test_answer_faults_and_sub_questions(spark, rows):
    bad = {"entities": [{"id": "1", "name": "A"}, {"id": "1", "name": ""}, {"name": "x"}], "relations": [{"source": "1", "relation": "r", "target": ["1", "9"], "evidence": "e"}, {"source": None, "relation": "r", "target": "1,1"}]}
    answers = spark.createDataFrame([(1, json.dumps(bad)), (2, "{}"), (3, None)], "k int, payload string")
    got = rows(graph.answer_faults(graph.read_results(answers, ["k"]), ["k"]))
    assert got == [(1, "no_evidence", 1), (1, "no_name", 1), (1, "repeated_id", 1), (1, "several_targets", 0), (1, "several_targets", 1), (1, "unknown_end", 0), (1, "unknown_end", 1)]
    asked = spark.createDataFrame([(1, "誰？ 何時?。好。"), (2, ""), (3, None)], "k int, t string")
    assert rows(asked.select("k", tx.sub_questions("t"))) == [(1, ["誰", "何時", "好"]), (2, []), (3, None)]
