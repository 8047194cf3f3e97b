from datetime import date

import pandas as pd
import pytest

from factloom.functions.time_text import clock, iso, readings, tidy
from factloom.operators.time_mixture import fit_mixture, normalise_times

LOW, HIGH = date(2019, 12, 29), date(2026, 1, 3)
ZONES = {"tw": ("Asia/Taipei", "ymd"), "us": ("America/New_York", "mdy"), "de": ("Europe/Berlin", "dmy"), "au": ("Australia/Sydney", "dmy")}


def run(spark, cases, order=True):
    data = [(i, d, t, f, ZONES[f][0] if f in ZONES else None, ZONES[f][1] if order and f in ZONES else None) for i, (d, t, f) in enumerate(cases)]
    df = spark.createDataFrame(data, "id int, d string, t string, feed string, zone string, ord string")
    out = normalise_times(df, "d", "t", "feed", "zone", "ord", "2019-12-29", "2026-01-03").select("id", iso("instant").alias("i"), "time_status", "time_format").collect()
    return {r["id"]: (r["i"], r["time_status"], r["time_format"]) for r in out}


CASES = [
    (("2025-01-17T05:50:00+08:00", None, "de"), "2025-01-16T21:50:00.000000Z"),
    ((None, "1749984720", "tw"), "2025-06-15T10:52:00.000000Z"),
    (("1583857320899", None, "tw"), "2020-03-10T16:22:00.899000Z"),
    (("20250416", None, "tw"), "2025-04-15T16:00:00.000000Z"),
    (("20230815T201400+0200", None, "de"), "2023-08-15T18:14:00.000000Z"),
    (("2021-10-12T10:23:00.138367789Z", None, "us"), "2021-10-12T10:23:00.138367Z"),
    (("2024-03-31T02:30:00", None, "de"), "2024-03-31T01:30:00.000000Z"),  # in the gap: later by an hour
    (("2024-10-27 02:30:00", None, "de"), "2024-10-27T00:30:00.000000Z"),  # twice: the first
    (("2021-07-06 24:00", None, "tw"), "2021-07-06T16:00:00.000000Z"),
    (("2022年2月27日", "08:14", "tw"), "2022-02-27T00:14:00.000000Z"),
    (("民國112年2月5日", None, "tw"), "2023-02-04T16:00:00.000000Z"),
    (("109.1.2", None, "tw"), "2020-01-01T16:00:00.000000Z"),
    (("22.05.2024 01:11", None, "us"), "2024-05-22T05:11:00.000000Z"),
    (("08/01/22", None, "de"), "2022-01-07T23:00:00.000000Z"),
    (("08/01/22", None, "us"), "2022-08-01T04:00:00.000000Z"),
    (("24/11/04", None, "tw"), "2024-11-03T16:00:00.000000Z"),
    (("０１／１５／２０２３", None, "us"), "2023-01-15T05:00:00.000000Z"),
    (("2023-W36-2", None, "tw"), "2023-09-04T16:00:00.000000Z"),
    (("Wed, 27 Dec 2023 18:06:30 +0800", None, "us"), "2023-12-27T10:06:30.000000Z"),
    (("Aug 13, 2020 6:35 PM EDT", None, "us"), "2020-08-13T22:35:00.000000Z"),
    (("2023年7月27日凌晨2時57分", None, "tw"), "2023-07-26T18:57:00.000000Z"),
    (("2021-02-19", "21:10:54+00:00", "de"), "2021-02-19T21:10:54.000000Z"),
    (("2022/10/23", "12:25 a.m.", "tw"), "2022-10-22T16:25:00.000000Z"),
    (("2025-11-12T06:58:05+08:00[Asia/Taipei]", None, "tw"), "2025-11-11T22:58:05.000000Z"),
    (("2020-10-04T02:30:00", None, "au"), "2020-10-03T16:30:00.000000Z"),
    (("25 October 2024", None, "de"), "2024-10-24T22:00:00.000000Z"),
]
NONE = ["2024-02-30", "0000-00-00", "近日", "昨（8）日", "2024-12", "2022年", "31/31/2021", "2023/13/05", "TBD", "2024-01-01 25:00", "2018-01-01", "x" * 100_000]


def test_known_instants(spark):
    got = run(spark, [c for c, _ in CASES])
    assert {i: got[i][0] for i in got} == {i: want for i, (_, want) in enumerate(CASES)}


def test_no_instant(spark):
    got = run(spark, [(t, None, "tw") for t in NONE] + [(None, None, "tw"), ("", "  ", "tw"), ("2024-05-05", None, None)])
    assert [got[i][:2] for i in range(len(got))] == [(None, "unread")] * len(NONE) + [(None, "none")] * 2 + [(None, "unread")]


def test_mixture_chooses_order_and_marks_doubt(spark):
    clear = [(f"{d:02d}/05/2024", None, "de") for d in range(13, 29)]
    got = run(spark, clear + [("03/04/2024", None, "de")], order=False)
    assert got[16][0] == "2024-04-02T22:00:00.000000Z" and got[16][2] == "dmy"
    got = run(spark, [("03/04/2024", None, "us"), ("05/05/2024", None, "us")], order=False)
    assert got[0][:2] == (None, "ambiguous")
    assert got[1][0] == "2024-05-05T04:00:00.000000Z"  # both readings are the same day


def test_mixture_weights():
    counts = pd.DataFrame({"source": ["s"] * 3, "signature": [["dmy"], ["dmy", "mdy"], ["mdy"]], "n": [900, 500, 3], "order": [None] * 3})
    fitted = fit_mixture(counts).set_index(counts["signature"].map(tuple))
    assert fitted.loc[[("dmy", "mdy")], "fmt"].iloc[0] == "dmy" and fitted.loc[[("dmy", "mdy")], "posterior"].iloc[0] > 0.99


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("2024-01-02", "a", 5)], "d string, feed string, instant int").selectExpr("*", "'UTC' zone", "cast(null as string) ord")
    out = normalise_times(df, "d", None, "feed", "zone", "ord", "2019-12-29", "2026-01-03")
    assert out.columns == ["d", "feed", "zone", "ord", "instant", "time_format", "posterior", "time_status"]
    assert out.select(iso("instant")).first()[0] == "2024-01-02T00:00:00.000000Z"
    assert normalise_times(df.limit(0), "d", None, "feed", "zone", "ord", "2019-12-29", "2026-01-03").count() == 0


@pytest.mark.parametrize("text,micros", [("24:00", 86400_000000), ("24:01", None), ("13:00 PM", None), ("下午12時05分", 43500_000000), ("晚上11點", 82800_000000), ("12:60", None), ("01:02:03.4567891", 3723_456789)])
def test_clock(text, micros):
    at = clock(tidy(text))
    assert (at and at[0]) == micros


def test_readings_in_every_order():
    assert [f for f, *_ in readings("05/06/2024", LOW, HIGH)[0]] == ["dmy", "mdy"]
    assert [f for f, *_ in readings("05.06.2024", LOW, HIGH)[0]] == ["dot"]
    assert [f for f, *_ in readings("24/05/06", LOW, HIGH)[0]] == ["ymd_yy"]


def test_declared_order_is_a_strong_prior(spark):
    other = [("05/13/2024", None, "de")] * 40  # no such day in the declared order
    got = run(spark, [("03/04/2024", None, "de"), *other])
    assert got[0][:2] == ("2024-04-02T22:00:00.000000Z", "ok") and all(got[i][:2] == (None, "unread") for i in range(1, 41))
    got = run(spark, [("03/04/2024", None, "de"), *other], order=False)
    assert got[0][2] == "mdy" and got[1][0] == "2024-05-12T22:00:00.000000Z"
    got = run(spark, [("03/04/2024", "10:00", "de"), ("03/04/2024", "25:00", "de"), (None, "03/04/2024 10:00", "de"), ("03/04/2024 10:00", None, "de")])
    assert [got[i][0] for i in range(4)] == ["2024-04-03T08:00:00.000000Z", None, "2024-04-03T08:00:00.000000Z", "2024-04-03T08:00:00.000000Z"]
