"""Literal cases of ids, lines, intervals, codes and states."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st, HealthCheck
from pyspark.sql import functions as F

from jobtide.functions import ids, states, text
from jobtide.operators import journal_ops, outcomes


def values(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_decode_cases(spark):
    cases = {
        "1A-q7-000": 74, "2Z-q7-001": 163, "10a-b-1": 4133, "012-3a": 66,
        "id1": 186881, "": 0, "-x": 0, "0Hymzl_Y-q1-00z": 1234567891234, "a.b-c": 37,
        "~" * 8: 2 ** 48 - 1, "0000012-x": 66, "00.0012-x": 0, "é000012-x": 0, "0000012": 66, "0" * 9: None,
    }
    assert values(spark, ids.decode64, list(cases)) == list(cases.values())


def test_encode_case(spark):
    assert values(spark, lambda v: ids.encode64(v, 7), [1234567891234], "long") == ["Hymzl_Y"]


def test_codes_sort_like_numbers_and_round_trip(spark):
    df = spark.range(300_000).withColumn("code", ids.encode64(F.col("id"), 4))
    assert df.where(ids.decode64(F.col("code")) != F.col("id")).count() == 0
    from pyspark.sql import Window as W
    prev = F.lag("code").over(W.partitionBy(F.floor(F.col("id") / 10_000)).orderBy("id"))
    assert df.withColumn("p", prev).where("p >= code").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2 ** 42 - 1), min_size=1, max_size=200))
def test_round_trip_any(spark, nums):
    assert values(spark, lambda v: ids.decode64(ids.encode64(v, 7)), nums, "long") == nums


def test_parse_cases(spark):
    lines = ["a|b|c|d", "a|b|", "  a|b|c", "|b|c", " |b|c", "   |b|c", "a|b|c\r", "a||c", "a|b", "",
             "bad-format", "a|b|x y", "　z|b|c", "a\r|b|c", "\r\na|b|c", "é|ü|ö|ß"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    want = {0: ("a", "b", "c|d"), 1: ("a", "b", ""), 2: ("a", "b", "c"), 4: (" ", "b", "c"),
            5: (" ", "b", "c"), 12: ("z", "b", "c"), 13: ("a\r", "b", "c"), 14: ("a", "b", "c"),
            15: ("é", "ü", "ö|ß"), 11: ("a", "b", "x y")}
    import re
    js = re.compile(r"^\s*([^|]+)\|([^|]+)\|([^\n\r  ]*)\Z")
    assert {i: js.match(s).groups() for i, s in enumerate(lines) if js.match(s)} == want
    got = sorted((r["id"], r["type"], r["data"]) for r in journal_ops.journal_parse(df).collect())
    assert got == sorted(want.values())
    rejects = {r["i"] for r in journal_ops.journal_rejects(df).collect()}
    assert rejects == set(range(len(lines))) - set(want)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab| \t\r\n é#", max_size=12), min_size=1, max_size=60))
def test_parse_like_the_pattern(spark, lines):
    import re
    js = re.compile("^[\\s﻿]*([^|]+)\\|([^|]+)\\|([^\n\r  ]*)\\Z")
    want = sorted(js.match(s).groups() for s in lines if js.match(s))
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    assert sorted((r["id"], r["type"], r["data"])
                  for r in journal_ops.journal_parse(df).collect()) == want


def test_deleted_lines(spark):
    df = spark.createDataFrame([("a|b|c",), (" a|b|c",)], "line string")
    assert journal_ops.journal_parse(df).count() == 2
    assert journal_ops.journal_parse(df, skip_deleted=True).count() == 1


def test_body_lines(spark):
    df = spark.createDataFrame([(1, "type1", "line1\n\nline2\n#\n")], "k int, jobtype string, body string")
    rows = journal_ops.body_to_lines(df).orderBy("pos").collect()
    assert [(r["pos"], r["ordinal"], r["line"]) for r in rows] == [(0, 0, "line1"), (2, 1, "line2")]


def test_intervals(spark):
    cases = {"10": 10, "200": 200, "3s": 3000, ".5s": 500, "0.5s": 500, "5.s": 5000, "29s": 29000,
             "1w": 604_800_000, " 2 m ": 120_000, "1h": 3_600_000, "1d": 86_400_000,
             "1e3": 1000, "": 0, " ": 0, "-5": -5,
             "one": None, "1x": None, ".": None, "-1s": None, "99999999999999999999w": None, "9e99": None}
    assert values(spark, text.interval_ms, list(cases)) == list(cases.values())


def test_leading_codes(spark):
    cases = {"200": 200, "200 x": 200, " +7z": 7, "some": None, "-3": None, "-0": 0, "x200": None,
             "": None, "404.5": 404, "-05": None, "2147483647 x": 2147483647, "2147483648": None,
             "99999999999999999999 x": None}
    assert values(spark, text.leading_code, list(cases)) == list(cases.values())


def test_outcome_classes(spark):
    codes = [100, 119, 200, 299, 300, 404, 500, 599, 600, 0, None]
    assert values(spark, states.outcome_class, codes, "int") == [
        "retry", "retry", "ok", "ok", "other", "failed", "error", "error", "other", "other", "other"]
    assert values(spark, states.is_final, codes, "int") == [
        False, False, True, True, False, True, False, False, False, False, False]


def test_states_at_the_boundary(make_jobs, now):
    jobs = make_jobs(("a", "t", 0, ""), ("b", "t", 0.001, ""), ("c", "t", 0, "s"),
                     ("d", "t", -0.001, "s"), ("e", "t", 0, "__done"), ("f", "t", 0, "__handler"))
    got = {r[0]: r[1] for r in jobs.select(
        "id", states.job_state(F.col("dt"), F.col("lock"), now)).collect()}
    assert got == {"a": "ready", "b": "deferred", "c": "running", "d": "abandoned", "e": "done",
                   "f": "handler"}


def test_done_at(make_jobs, now):
    jobs = make_jobs(("a", "t", 0, "s")).select(states.done_at(states.archive_dt(F.col("dt"))).alias("d"))
    assert jobs.first().d == now


@pytest.mark.parametrize("output,kinds", [
    ("200 x\n\n# note\n#J: t|p\n  \n404", {"response": ["200 x", "  ", "404"],
                                           "comment": ["# note", "#J: t|p"], "new_job": ["#J: t|p"]}),
    ("\n\n  200\n", {"response": ["200"]}),
    ("", {}),
])
def test_split_output(spark, output, kinds):
    df = spark.createDataFrame([(1, output)], "batch int, output string")
    got: dict = {}
    for r in outcomes.split_output(df).orderBy("kind", "pos").collect():
        got.setdefault(r["kind"], []).append(r["line"])
    assert got == kinds


def test_align_outcomes(spark):
    jobs = spark.createDataFrame(
        [(b, p, f"{b}{p}", "t") for b, n in (("bad", 4), ("half", 6), ("none", 2)) for p in range(n)],
        "batch string, pos int, id string, type string")
    outputs = spark.createDataFrame(
        [("bad", "200\n200 x\nsome\n200"), ("half", "200\n# c\n201\n")], "batch string, output string")
    rows = outcomes.align_outcomes(jobs, outputs).orderBy("batch", "pos").collect()
    assert [(r["exitcode"], r["code"]) for r in rows] == [
        (200, None), (200, None), (500, "INVALID_RESPONSE"), (500, "INVALID_RESPONSE"),
        (200, None), (201, None), *[(500, "NO_RESPONSE")] * 4,
        (500, "NO_RESPONSE"), (500, "NO_RESPONSE")]


def test_request_errors_and_durations(spark, now):
    jobs = spark.createDataFrame([(1, "a", "t"), (1, "b", "t"), (2, "c", "t")],
                                 "batch int, id string, type string")
    failed = spark.createDataFrame([(1, None), (2, "ECONNRESET")], "batch int, error_code string")
    assert sorted((r["id"], r["exitcode"], r["code"])
                  for r in outcomes.request_errors(jobs, failed).collect()) == [
        ("a", 500, "BATCH_ERROR"), ("b", 500, "BATCH_ERROR"), ("c", 500, "ECONNRESET")]
    calls = spark.createDataFrame(
        [(1, now, now + dt.timedelta(milliseconds=300), True), (2, now, now, True)],
        "batch int, started timestamp, stopped timestamp, is_batch boolean")
    outputs = spark.createDataFrame([(1, "200\n200\n200"), (2, "# none")], "batch int, output string")
    got = {r["id"]: r["duration"] for r in outcomes.run_durations(jobs, calls, outputs).collect()}
    assert got == {"a": 100.0, "b": 100.0, "c": None}
