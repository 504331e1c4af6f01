"""Numbering and running sums over slices against plain loops, with a hot group."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobtide.operators import concurrency, counts, handlers as h, journal_ops, schedules as sch
from jobtide.operators.ordered import clamp_summary, clamped_counts, number_rows, running_sums


@pytest.fixture(scope="module")
def data():
    """One group holds half of the rows; a NULL group too; order values spread and clustered."""
    rng = random.Random(7)
    groups = ["hot"] * 50 + [f"g{i}" for i in range(30)] + [None] * 5
    at = rng.sample(range(100_000), 1500) + list(range(200_000, 201_500))
    return [(rng.choice(groups), a, rng.choice([-2, -1, -1, 1, 1, 2])) for a in at]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "g string, at long, d int").repartition(8).cache()


def by_group(data):
    groups = defaultdict(list)
    for g, at, d in sorted(data, key=lambda r: r[1]):
        groups[g].append((at, d))
    return groups


def test_number_rows(frame, data):
    got = {(r["g"], r["at"]): r["n"] for r in number_rows(frame, ["g"], ["at"]).collect()}
    assert got == {(g, at): i + 1 for g, rs in by_group(data).items() for i, (at, _) in enumerate(rs)}
    everyone = {r["at"]: r["n"] for r in number_rows(frame, [], ["at"]).collect()}
    assert everyone == {at: i + 1 for i, at in enumerate(sorted(at for _, at, _ in data))}


def test_hot_group_is_spread(spark, frame):
    from jobtide.operators.ordered import _sliced
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data
    try:
        sizes = _sliced(frame.repartition(8), ["g"], ["at"]).groupBy("_slice").count()
        top = sizes.agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert top < frame.count() / 4  # the hot group alone is over half of the rows


def test_running_sums(frame, data):
    got = {(r["g"], r["at"]): (r["s"], r["k"]) for r in running_sums(
        frame, ["g"], ["at"], {"s": F.col("d"), "k": F.lit(1)}).collect()}
    want = {}
    for g, rs in by_group(data).items():
        s = 0
        for i, (at, d) in enumerate(rs):
            s += d
            want[g, at] = (s, i + 1)
    assert got == want


def test_clamped_counts(frame, data):
    got = {(r["g"], r["at"]): (r["x"], r["x_before"])
           for r in clamped_counts(frame, ["g"], ["at"], "d").collect()}
    ends = {r["g"]: r["total"] - r["low"] for r in clamp_summary(frame, ["g"], ["at"], "d").collect()}
    want, last = {}, {}
    for g, rs in by_group(data).items():
        x = 0
        for at, d in rs:
            before, x = x, max(0, x + d)
            want[g, at] = (x, before)
        last[g] = x
    assert got == want
    assert ends == last


def test_clamp_case(spark):
    df = spark.createDataFrame(list(enumerate([7, 5, -2, -9, -4, 3])), "at int, d int")
    rows = clamped_counts(df, [], ["at"], "d").orderBy("at").collect()
    assert [r["x"] for r in rows] == [7, 12, 10, 1, 0, 3]


def test_scheduler_events(spark):
    import datetime as dt
    ev = [("a", 1, 7), ("a", 1, 5), ("b", 1, 3), ("a", 0, -2), ("a", 0, -9), ("b", 0, -4)]
    df = spark.createDataFrame(
        [(t, dt.datetime(2024, 1, 1, 0, 0, i), str(i), 1, k, d) for i, (t, k, d) in enumerate(ev)],
        "type string, ev_at timestamp, id string, attempt int, kind int, d int")
    totals = concurrency.running_totals(df).orderBy("ev_at").collect()
    assert [(r["started_total"], r["running_total"], r["active_types"]) for r in totals] == [
        (7, 7, 1), (12, 12, 1), (15, 15, 2), (15, 13, 2), (15, 4, 2), (15, 0, 1)]
    assert {(r["type"], r["x"], r["idle"]) for r in concurrency.idle_types(df).collect()} == {
        ("a", 1, False), ("b", 0, True)}


def test_ids_are_unique_and_rise_over_the_sequence_limit(spark):
    from jobtide.functions import ids
    df = spark.range(0, 600_000).withColumn("job", ids.numbered_id(F.col("id"), F.lit("s"), 1_700_000_000_000))
    assert df.select("job").distinct().count() == 600_000
    ends = {r["id"]: r["job"] for r in df.where("id IN (0, 262143, 262144, 599999)").collect()}
    assert sorted(ends.values()) == [ends[k] for k in sorted(ends)]
    assert ends[262143][-3:] == "~~~" and ends[262144][-3:] == "000"


def test_id_assign(spark):
    df = spark.range(5000).select(F.col("id").alias("k")).repartition(8)
    got = journal_ops.id_assign(df, ["k"], "s", 1_700_000_000_000).orderBy("k").collect()
    assert [r["id"] for r in got] == sorted({r["id"] for r in got})


def test_group_by_field_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, None)], "id int, a int")
    got = [tuple(r) for r in counts.group_by_field(df, F.col("a"), ["id"]).orderBy("grp", "pos").collect()]
    assert got == [(None, 0, 4), ("1", 0, 1), ("1", 1, 3), ("2", 0, 2)]


def test_batches(spark):
    jobs = spark.createDataFrame([("A", f"{i:03}") for i in range(25)] + [("B", "1")], "type string, id string")
    handlers = spark.createDataFrame([("1", "A", 10), ("2", "A", 7)], "id string, type string, batch_size int")
    got = [tuple(r) for r in h.assign_batches(jobs, handlers).orderBy("type", "id").collect()]
    assert got == [("A", f"{i:03}", i // 7, i % 7) for i in range(25)] + [("B", "1", 0, 0)]


def test_expand_long_run_in_chunks(spark):
    df = spark.createDataFrame([(1, "2", 5), (2, "0", 0), (3, "x", 0)],
                               "schedule_id int, interval string, start_ms long")
    got = sorted(r["fire_ms"] for r in sch.schedule_expand(df, 10, 9000).collect())
    assert got == list(range(11, 9000, 2))
    edge = sch.schedule_expand(df.withColumn("start_ms", F.lit(4).cast("long")), 10, 13)
    assert sorted(r["fire_ms"] for r in edge.collect()) == [10, 12]
