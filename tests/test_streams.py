"""Streams over several micro-batches: same results as in batch, replays included."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtide.functions import ids
from jobtide.plans import feeds
from jobtide.operators import concurrency, counts, journal_ops
from jobtide.session import work_path
from jobtide.sources import journal as js
from jobtide.streaming import ingest as si, locks as sl, outcomes as so
from jobtide.streaming.run import ObservedSums, StatsHook, StatsTable, drain_to, drain_to_folder

SF = "/root/testdata/sf0.001"
NOW = feeds.AS_OF


@pytest.fixture(scope="module")
def lines(spark):
    path = work_path(spark, "lines")
    js.journal_write(feeds.journal(spark, SF).repartition(6), path)
    return path


def test_ingest_resumes_where_it_stopped(spark, lines):
    path, offsets = work_path(spark, "jobs"), work_path(spark, "offsets")
    first = drain_to_folder(si.stream_ingest(js.journal_stream(spark, lines, max_files=2)), "i", offsets, path)
    n = first.count()
    assert n == journal_ops.journal_parse(js.journal_scan(spark, lines)).count()
    spark.createDataFrame([("0NBtO6n-x-000|t|p",)], "value string").write.mode("append").text(lines)
    again = drain_to_folder(si.stream_ingest(js.journal_stream(spark, lines, max_files=2)), "i", offsets, path)
    assert again.count() == n + 1


def test_upsert_replay_gives_the_same_table(spark, lines):
    sink = si.UpsertSink(work_path(spark, "upsert"), NOW, ["type", "data"])
    batches = []

    def keep(rows, batch_id):
        path = work_path(spark, "kept")
        rows.write.parquet(path)
        batches.append((spark.read.parquet(path), batch_id))
        sink(rows, batch_id)

    drain_to(si.stream_ingest(js.journal_stream(spark, lines, max_files=2)), keep, "upsert")
    assert len(batches) >= 3
    want = sorted(tuple(r) for r in sink.read(spark).collect())
    assert len({r[0] for r in want}) == len(want)
    parsed = journal_ops.journal_parse(js.journal_scan(spark, lines))
    assert {r[0] for r in want} == {r["id"] for r in parsed.select("id").collect()}
    for rows, batch_id in batches[-2:]:
        sink(rows, batch_id)
    assert sorted(tuple(r) for r in sink.read(spark).collect()) == want


def test_running_counts_over_batches_and_replay(spark):
    keeper = sl.RunningCounts(work_path(spark, "running"))
    start = dt.datetime(2024, 1, 1)
    steps = [[("a", 7), ("a", 5), ("b", 3)], [("a", -2), ("b", -4)], [("a", -9), ("c", 1)], [("b", 1), ("b", 1)]]
    n = 0
    for batch_id, step in enumerate(steps):
        events = []
        for t, d in step:
            events.append((t, start + dt.timedelta(seconds=n), str(n), 1, int(d > 0), d))
            n += 1
        df = spark.createDataFrame(events, "type string, ev_at timestamp, id string, attempt int, kind int, d int")
        keeper(df, batch_id)
        keeper(df, batch_id)
    got = {r["type"]: (r["x"], r["started_total"]) for r in keeper.read(spark, len(steps) - 1).collect()}
    assert got == {"a": (1, 12), "b": (2, 5), "c": (1, 1)}


def test_running_counts_stream_equals_batch(spark):
    events = feeds.start_stop(spark, SF).orderBy("ev_at")
    path = work_path(spark, "events")
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-02-10")]):
        (events.where(f"ev_at >= '{lo}' AND ev_at < '{hi}'").coalesce(1).write.mode("append").parquet(path))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    keeper = sl.RunningCounts(work_path(spark, "running"))
    last = drain_to(stream, keeper, "running").lastProgress["batchId"]
    assert last >= 1
    got = {(r["type"], r["x"]) for r in keeper.read(spark, last).collect()}
    assert got == {(r["type"], r["x"]) for r in concurrency.idle_types(events).collect()}


def _files(spark, schema, *batches):
    """A folder stream with one file per batch, in order."""
    path = work_path(spark, "files")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_runs_are_dropped(spark):
    t = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    stream = _files(spark, "type string, exitcode int, stopped timestamp",
                    [("a", 200, t(0)), ("a", 200, t(1)), ("a", 500, t(30))],
                    [("a", 200, t(31))],  # rows are late by the watermark of the batch before
                    [("a", 200, t(25)), ("a", 200, t(2))], [("a", 200, t(59))])
    got = sorted((r["window_ms"] // 60000 % 60, r["class"], r["n"])
                 for r in drain_to_folder(so.stream_outcome_windows(stream), "late").collect())
    assert got == [(0, "ok", 1), (1, "ok", 1), (25, "ok", 1), (30, "error", 1), (31, "ok", 1)]


def test_lock_expiry_boundary(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    stream = _files(spark, "id string, lock string, kind string, ev_at timestamp",
                    [("kept", "d", "claim", t(0)), ("kept", "d", "renew", t(300)), ("kept", "d", "stop", t(600)),
                     ("lost", "d", "claim", t(0)), ("lost", "d", "stop", t(301)),
                     ("gone", "d", "claim", t(0)), ("gone", "d", "renew", t(100))],
                    [("end", "d", "claim", t(9000))])
    got = {(r["id"], r["claimed_ms"] // 1000 % 86400, r["expired_ms"] // 1000 % 86400, r["events"])
           for r in drain_to_folder(sl.stream_lock_expiry(stream), "stale").collect()}
    assert got == {("lost", 0, 300, 1), ("gone", 0, 400, 2)}


def _job(id_, t):
    return (id_, "t", t, "", "x")


JOBS = "id string, type string, dt timestamp, lock string, data string"


def _unique(spark, stream):
    sink = si.UniqueSink(work_path(spark, "dedup"), ["type", "data"])
    drain_to(stream, sink, "dedup")
    return sorted(r["id"] for r in sink.read(spark).collect())


def test_dedup_across_batches(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    stream = _files(spark, JOBS, [_job("a", t(0)), _job("b", t(1)), _job("a", t(0))], [_job("a", t(0)), _job("c", t(60))], [_job("b", t(1))])
    assert _unique(spark, stream) == ["a", "b", "c"]


def test_retry_ready_bounds(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    releases = _files(spark, "id string, attempt int, released timestamp",
                      [("a", 1, t(0)), ("b", 1, t(0)), ("z", 1, t(2))], [("c", 1, t(1)), ("late", 1, t(500))])
    runs = _files(spark, "id string, attempt int, started timestamp",
                  [("a", 2, t(3)), ("b", 2, t(11)), ("z", 1, t(2))], [("a", 3, t(10)), ("c", 2, t(6)), ("end", 1, t(500))])
    got = sorted((r["id"], r["next_attempt"], r["early"])
                 for r in drain_to_folder(so.stream_retry_ready(releases, runs), "ready").collect())
    # the first run only; none within the bound; a run of no length is not its own retry
    assert got == [("a", 2, True), ("b", None, None), ("c", 2, False), ("z", None, None)]


def test_stats_go_to_the_emitter_of_the_day(spark, lines):
    first, second = StatsTable(work_path(spark, "stats")), StatsTable(work_path(spark, "stats"))
    hook = StatsHook(first)
    ingest = si.ingest_with_stats(si.UniqueSink(work_path(spark, "jobs"), ["type", "data"]), hook)

    def then_other(rows, batch_id):
        ingest(rows, batch_id)
        ingest(rows, batch_id)  # a replay counts once
        hook.configure(second)

    drain_to(js.journal_stream(spark, lines, max_files=3), then_other, "stats")
    emitted = [counts.stats_totals(t.read(spark)) for t in (first, second)]
    assert all(e.where("kind = 'read'").first().n > 0 for e in emitted)
    want = sorted((tuple(r) for r in journal_ops.ingest_counts(js.journal_scan(spark, lines)).collect()), key=repr)
    both = counts.stats_totals(emitted[0].unionByName(emitted[1]))
    assert sorted((tuple(r) for r in both.collect()), key=repr) == want


def test_observed_counts(spark, lines):
    jobs = si.stream_ingest(js.journal_stream(spark, lines, max_files=3))
    counted = jobs.observe("ingest", F.count(F.lit(1)).alias("jobs"))
    with ObservedSums(spark, "ingest") as seen, ObservedSums(spark, "other") as other:
        drain_to(counted, lambda rows, _: rows.write.format("noop").mode("overwrite").save(), "observe")
    assert seen.sums == {"jobs": journal_ops.journal_parse(js.journal_scan(spark, lines)).count()}
    assert seen.batches > 1 and other.sums == {}


def test_dedup_keeps_first_copies_out_of_order(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    stream = _files(spark, JOBS, *[[_job(f"id{n}", day(n))] for n in (10, 11, 1, 12, 10, 1)])
    assert _unique(spark, stream) == ["id1", "id10", "id11", "id12"]


def test_claim_after_a_stop_expires(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "id string, lock string, kind string, ev_at timestamp"
    stream = _files(spark, schema, [("a", "d", "claim", t(0)), ("a", "d", "stop", t(60)), ("a", "d", "claim", t(120)),
                                    ("b", "d", "claim", t(0)), ("b", "d", "stop", t(0))], [("z", "d", "stop", t(9000))])
    got = [(r["id"], r["expired_ms"] - r["claimed_ms"]) for r in drain_to_folder(sl.stream_lock_expiry(stream), "stale").collect()]
    assert got == [("a", 420_000)]


def _upsert(spark, sink, batch: int, *ids_: str) -> None:
    sink(spark.createDataFrame([(i, "t", None, "", "x") for i in ids_], "id string, type string, dt timestamp, lock string, data string"), batch)


def test_upsert_of_ids_without_a_day(spark):
    sink = si.UpsertSink(work_path(spark, "upsert"), NOW, ["type", "data"])
    _upsert(spark, sink, 0, "zzzzzzzzzzzz-q0-001")
    _upsert(spark, sink, 1, "zzzzzzzzzzzz-q0-001", "zzzzzzzzzzzz-q0-002")
    assert sink.read(spark).count() == 2


def test_upsert_writes_what_is_new_only(spark):
    sink = si.UpsertSink(work_path(spark, "upsert"), NOW, ["type", "data"])
    files = lambda: set(spark.read.parquet(sink.path).inputFiles())
    seen = set()
    for batch in (0, 1, 2, 3, 4, 4, 5):
        _upsert(spark, sink, batch, f"zzzzzzzzzzzz-q0-{batch}", "zzzzzzzzzzzz-q0-x")
        assert seen <= files() and len(files() - seen) <= 2  # no file is written again
        seen = files()
    assert sink.read(spark).count() == 7


def test_upsert_with_a_new_checkpoint_overwrites_nothing(spark, lines):
    path = work_path(spark, "upsert")
    want = None
    for label in ("first", "second"):
        sink = si.UpsertSink(path, NOW, ["type", "data"])
        drain_to(si.stream_ingest(js.journal_stream(spark, lines, max_files=3)), sink, label)
        got = sorted(r["id"] for r in sink.read(spark).select("id").collect())
        want = want or got
        assert got == want and len(set(got)) == len(got)
