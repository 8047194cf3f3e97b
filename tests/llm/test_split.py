from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.split import boundaries, pack, split_items, text_members

TEXT = st.text(alphabet="ab 。.\n#-1、", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces, hard = pack(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
    assert all(b - max(0, a - overlap) <= limit and b > a for a, b, _ in pieces)
    places = {p for p, _ in boundaries(text)[0]} | {len(text)}
    assert all((b in places) == natural or not natural for a, b, natural in pieces)
    runs, run = [0], 0
    for i, c in enumerate(text):
        run = 0 if c in "。\n" or (c == "." and text[i + 1 : i + 2].isspace()) else run + 1
        runs.append(run)
    assert hard == (max(runs) > limit)


def test_cuts_at_the_highest_boundary_that_fits():
    text = "# one\n" + "x" * 30 + "。" + "y" * 30 + "\n\n# two\n" + "z" * 50
    pieces, hard = pack(text, 80, 0)
    assert [text[a:b] for a, b, _ in pieces] == [text[: text.index("# two")], text[text.index("# two") :]] and not hard


def test_operator_edges(spark, rows):
    long = "a" * 5000
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "x" * 600, "p"), (4, long, "p"), (4, long, None), (None, "。" * 601, "p")], "k int, t string, piece string")
    got = split_items(df, ["k"], "t").collect()
    four = [r for r in got if r["k"] == 4]
    assert len(four) == 2 * (1 + -(-4400 // 540)) and all(len(r["piece"]) <= 600 and r["hard"] for r in four)
    assert {r["hard"] for r in got if r["k"] is None} == {False}
    assert {r["k"] for r in got} == {4, None}
    assert split_items(df.limit(0), ["k"], "t").count() == 0
    props = spark.createDataFrame([(1, '{"a":"%s","b":5,"c":{"d":"%s"}}' % ("\\u4e2d" * 700, "x" * 700)), (2, '{"a":"%s"' % ("x" * 700)), (3, None)], "r int, j string")
    assert [(r["r"], r["field"], len(r["value"])) for r in text_members(props, "r", "j", 600).collect()] == [(1, "a", 700)]


def test_tails_are_not_merged_across_parents():
    section = lambda name, *sizes: f"# {name}\n\n" + "".join("句" * (n - 1) + "。" for n in sizes)
    text = section("A", 50, 60, 20) + "\n" + section("B", 30, 10) + "\n" + section("C", 20)
    got, hard = pack(text, 100, 10)
    parts = [text[a:b] for a, b, _ in got]
    assert "".join(parts) == text and not hard and all(natural for *_, natural in got)
    assert not any("A" in p and "B" in p for p in parts) and parts[-1].count("#") == 2  # B and C are whole siblings, A's tail stays by itself
    assert all(b - a <= (90 if a else 100) for a, b, _ in got)


def test_tags_within_a_line_cut_only_what_has_no_sentence_end():
    text = "<ul>" + "".join(f"<li>{'x' * 40}</li>" for _ in range(5)) + "</ul>"
    got, hard = pack(text, 100, 10)
    assert hard and all(text[a:b].startswith(("<ul>", "<li>", "</ul>")) for a, b, _ in got) and "".join(text[a:b] for a, b, _ in got) == text
