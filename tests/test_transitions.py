"""Scenario chains over small job tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtide.operators import counts, handlers as h, leases as ls, outcomes, transitions as tr
from jobtide.schema import JOB


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_add_jobs(spark, make_jobs, now):
    bad = [(None, "t"), ("", "t"), ("a", None), ("a", ""), (None, None)]
    jobs = make_jobs(("j1", "t1", None, ""), ("j2", "t2", 1, ""), *[(i, t, None, "") for i, t in bad])
    flagged = tr.add_jobs(jobs, now)
    assert rows(tr.next_table(flagged), "id", "dt") == [("j1", now), ("j2", now + dt.timedelta(seconds=1))]
    assert tr.affected(flagged).count() == len(bad)


def test_add_unique_ids(make_jobs, now):
    table = make_jobs(("a", "t", 0, "s", "old"))
    new = make_jobs(("a", "t", 0, "", "new"), ("b", "t", 0, "", "2"), ("b", "t", 0, "", "1"))
    got = tr.add_jobs_unique(table, new, now, ["data"])
    assert rows(got, "id", "lock", "data") == [("a", "s", "old"), ("b", "", "1")]


def test_claim_is_limited_and_leaves_others(make_jobs, now):
    jobs = make_jobs(*[(f"a{i}", "A", -i, "") for i in range(8)], ("a9", "A", 5, ""),
                     ("a00", "A", -1, "other"), ("b1", "B", -1, ""))
    claimed = tr.claim_jobs(jobs, now, "me", 3, 2000)
    assert rows(claimed.where("changed"), "id", "lock", "dt") == [
        (i, "me", now + dt.timedelta(seconds=2)) for i in ("a0", "a1", "a2", "b1")]
    assert claimed.count() == jobs.count()
    again = tr.claim_jobs(tr.next_table(claimed), now, "me2", 3)
    assert rows(again.where("changed"), "id") == [("a3",), ("a4",), ("a5",)]


def test_claim_limits_per_type(spark, make_jobs, now):
    jobs = make_jobs(*[(f"{t}{i}", t, -1, "") for t in "ABC" for i in range(6)])
    limits = spark.createDataFrame([("A", 5), ("B", None), ("C", 0)], "type string, batch_size int")
    got = tr.claim_jobs(jobs, now, "me", 2, limits=limits).where("changed")
    assert rows(got.groupBy("type").count(), "type", "count") == [("A", 5), ("B", 2), ("C", 2)]


def test_a_handler_size_is_taken_as_it_is(spark, make_jobs, now):
    jobs = make_jobs(*[(f"A{i:03}", "A", -1, "") for i in range(300)])
    limits = spark.createDataFrame([("A", 250)], "type string, batch_size int")
    assert tr.claim_jobs(jobs, now, "me", 2, limits=limits).where("changed").count() == 250


def test_limit_with_repeated_ids(make_jobs, now):
    jobs = make_jobs(("a", "t", -1, "", "1"), ("a", "t", -1, "", "2"), ("b", "t", -1, "", "1"), ("b", "t", -1, "", "2"))
    got = tr.conditional_update(jobs, F.col("lock") == "", {"lock": F.lit("x")}, limit=3)
    assert rows(got, "id", "data", "lock") == [("a", "1", "x"), ("a", "2", "x"), ("b", "1", "x"), ("b", "2", "")]


def test_purge_by_age_and_limit(make_jobs, now):
    jobs = make_jobs(("a", "t", -100, ""), ("b", "t", -90, ""), ("c", "t", -10, ""), ("d", "u", -100, ""))
    assert rows(tr.affected(tr.purge_jobs(jobs, type="t", now=now, older_ms=50_000)), "id") == [("a",), ("b",)]
    assert rows(tr.affected(tr.purge_jobs(jobs, type="t", now=now, older_ms=50_000, limit=1)), "id") == [("a",)]
    with pytest.raises(ValueError):
        tr.purge_jobs(jobs, type="t")


@pytest.mark.parametrize("how,lock,secs", [("retry", "", 300), ("unget", "", 0), ("archive", "__done", None)])
def test_release(spark, make_jobs, now, how, lock, secs):
    jobs = make_jobs(("a", "t", 100, "me"), ("b", "t", 100, "me"), ("c", "t", 100, "you"))
    wanted = spark.createDataFrame([(i, "me", how) for i in "ac"], "id string, lock string, how string")
    got = tr.release_jobs(jobs, wanted, now).where("changed").collect()
    want = now.replace(year=3024) if secs is None else now + dt.timedelta(seconds=secs)
    assert [(r["id"], r["lock"], r["dt"]) for r in got] == [("a", lock, want)]


def test_leap_day_archive(make_jobs):
    from jobtide.functions import states
    day = dt.datetime(2024, 2, 29)
    jobs = make_jobs(("a", "t", day, "s")).select(states.archive_dt(F.col("dt")).alias("d"))
    assert jobs.first().d == dt.datetime(3024, 2, 29)


def test_stale_locks(make_jobs, now):
    jobs = make_jobs(("a", "t", -1, "s"), ("b", "t", 1, "s"), ("c", "t", 0, "s"), ("d", "t", -1, ""),
                     ("e", "t", -1, None))
    got = tr.expire_locks(jobs, now)
    assert rows(got.where("changed"), "id", "lock", "dt") == [("a", "", now), ("e", "", now)]


def test_renew_own_locks_only(spark, make_jobs, now):
    jobs = make_jobs(("a", "t", 1, "me"), ("b", "t", 1, "you"), ("c", "t", 1, "me"))
    held = spark.createDataFrame([("a", "me"), ("b", "me"), ("a", "me")], "id string, lock string")
    got = tr.renew_locks(jobs, held, now, 5000)
    assert rows(got.where("changed"), "id", "dt") == [("a", now + dt.timedelta(seconds=5))]
    assert got.count() == 3
    assert rows(tr.held_jobs(jobs, held), "id") == [("a",)]


def test_two_holders_of_one_id_do_not_double_the_row(spark, make_jobs, now):
    jobs = make_jobs(("a", "t", 1, "me"), ("b", "t", 1, None))
    held = spark.createDataFrame([("a", "me"), ("a", "you"), ("b", None)], "id string, lock string")
    wanted = held.withColumn("how", F.lit("retry"))
    for flagged in (tr.renew_locks(jobs, held, now), tr.release_jobs(jobs, wanted, now)):
        assert rows(flagged, "id", "changed") == [("a", True), ("b", False)]
    assert rows(tr.upkeep(jobs, held, now), "id", "action") == [("a", "renew"), ("b", None)]


def test_transitions_keep_the_columns(spark, make_jobs, now):
    jobs = make_jobs(("a", "t", 1, "me"))
    held = spark.createDataFrame([("a", "me")], "id string, lock string")
    wanted = held.withColumn("how", F.lit("retry"))
    for flagged in (tr.conditional_update(jobs, F.lit(True), {"lock": F.lit("x")}, limit=1),
                    tr.claim_jobs(jobs, now, "x", 1), tr.renew_locks(jobs, held, now),
                    tr.release_jobs(jobs, wanted, now), tr.expire_locks(jobs, now),
                    tr.purge_jobs(jobs, now, lock="x"), tr.add_jobs(jobs, now)):
        assert tr.next_table(flagged).columns == jobs.columns


def test_purge(make_jobs, now):
    jobs = make_jobs(("a", "A", -5, "x"), ("b", "A", -5, "y"), ("c", "B", -5, "x"), ("d", "A", 5, "x"))
    with pytest.raises(ValueError):
        tr.purge_jobs(jobs, now)
    assert rows(tr.affected(tr.purge_jobs(jobs, now, type="A")), "id", "data") == [("a", None), ("b", None)]
    assert rows(tr.affected(tr.purge_jobs(jobs, now, lock="x")), "id") == [("a",), ("c",)]
    assert rows(tr.affected(tr.purge_jobs(jobs, now, type="A", lock="x")), "id") == [("a",)]
    kept = tr.next_table(tr.purge_jobs(jobs, now, type="A", lock="x"))
    assert rows(kept, "id", "data") == [("b", "x"), ("c", "x"), ("d", "x")]


def test_purge_done_counts_from_completion(make_jobs, now):
    day = 86400
    jobs = make_jobs(("old", "t", (now - dt.timedelta(days=15)).replace(year=3024), "__done"),
                     ("new", "t", (now - dt.timedelta(days=13)).replace(year=3024), "__done"),
                     ("unrun", "t", -31 * day, ""), ("due", "t", -29 * day, ""))
    assert rows(tr.affected(tr.purge_done(jobs, now)), "id") == [("old",)]
    assert rows(tr.affected(tr.purge_unrun(jobs, now)), "id") == [("unrun",)]


def test_conditional_update(make_jobs, now):
    jobs = make_jobs(*[(f"j{i}", "t", i, "") for i in range(6)])
    got = tr.conditional_update(jobs, F.col("dt") > now, {"lock": F.concat("id", F.lit("!"))}, limit=2)
    assert rows(got.where("changed"), "id", "lock") == [("j1", "j1!"), ("j2", "j2!")]
    gone = tr.conditional_update(jobs, F.col("dt") > now, remove=True, limit=3)
    assert rows(tr.next_table(gone), "id") == [("j0",), ("j4",), ("j5",)]


def test_outcomes_last_run_decides(spark, now):
    from jobtide.functions import ids
    base = spark.createDataFrame(
        [("new", 0), ("new2", 1), ("old", -7 * 3600_000), ("ok", 2)], "k string, ms long")
    jobs = base.select(
        F.concat(ids.encode64(F.col("ms") + F.lit(1705363200000), 7), F.lit("-d0-"), "k").alias("id"),
        F.lit("t").alias("type"), F.lit(now).alias("dt"), F.lit("d0").alias("lock"), F.lit("x").alias("data"))
    key = F.element_at(F.split("id", "-"), -1)
    runs = spark.createDataFrame(
        [("new", 1, 200), ("new", 2, 100), ("new2", 1, 500), ("old", 1, 300), ("ok", 1, 500), ("ok", 2, 404)],
        "k string, attempt int, exitcode int")
    runs = jobs.withColumn("k", key).join(runs, "k").select(
        "id", F.lit("d0").alias("runner"), "exitcode", "attempt", F.lit(now).alias("stopped"))
    got = tr.apply_outcomes(jobs, runs, now).withColumn("k", key)
    assert rows(got, "k", "lock") == [("new", ""), ("new2", ""), ("ok", "__done"), ("old", "d0")]
    got = tr.apply_outcomes(jobs, runs, now, on_abandon="archive").withColumn("k", key)
    assert rows(got, "k", "lock") == [("new", ""), ("new2", ""), ("ok", "__done"), ("old", "__done")]


def test_upkeep_equals_its_steps(spark, make_jobs, now):
    day = 86400
    jobs = make_jobs(("held", "t", -1, "me"), ("stale", "t", -1, "you"), ("run", "t", 9, "you"),
                     ("oldd", "t", (now - dt.timedelta(days=15)).replace(year=3024), "__done"),
                     ("unrun", "t", -31 * day, ""), ("ready", "t", -1, ""))
    held = spark.createDataFrame([("held", "me")], "id string, lock string")
    got = tr.upkeep(jobs, held, now)
    step = tr.next_table(tr.renew_locks(jobs, held, now))
    step = tr.next_table(tr.expire_locks(step, now))
    step = tr.next_table(tr.purge_done(step, now))
    step = tr.next_table(tr.purge_unrun(step, now))
    kept = got.where("action IS NULL OR NOT startswith(action, 'purge')").select(*JOB.names)
    assert rows(kept, *JOB.names) == rows(step, *JOB.names)


def test_locked_jobs(make_jobs):
    jobs = make_jobs(*[(f"{i}", "AB"[i % 2], i, "xy"[i % 3 == 0]) for i in range(7)], ("u", "A", 0, ""))
    assert rows(tr.locked_jobs(jobs, 2, type="A", lock="x"), "id") == [("2",), ("4",)]
    assert tr.locked_jobs(jobs, 100).count() == 7
    assert tr.locked_jobs(jobs, 100, lock="z").count() == 0


def test_counts_skip_lease_rows(make_jobs, now):
    jobs = make_jobs(("a", "t", -1, ""), ("b", "queue.sysid", -1, ""), ("c", "u", -1, "me"),
                     ("d", "queue.sysid", 5, "d"), ("e", "v", -1, "__done"), ("f", "w", -1, None))
    assert rows(counts.waiting_counts(jobs, now), "type", "n") == [("t", 1)]
    assert rows(counts.waiting_types(jobs, now, include_system=True), "type") == [("queue.sysid",), ("t",)]
    assert rows(counts.running_types(jobs), "type") == [("u",), ("w",)]


def test_handlers(spark):
    versions = spark.createDataFrame(
        [("0", "A", "js", "x", 3), ("2", "A", "js", "z", None), ("1", "A", "js", "y", 4),
         ("1", "B", "js", None, 2), ("1", "C", None, "q", 2)],
        "id string, type string, lang string, body string, batch_size int")
    newest = {r["type"]: (r["id"], r["body"], r["batch_size"]) for r in h.latest_handler(versions).collect()}
    assert newest == {"A": ("2", "z", None), "B": ("1", None, 2), "C": ("1", "q", 2)}
    put = h.put_handlers(versions)
    assert rows(tr.affected(put), "type") == [("B",), ("C",)]
    jobs = spark.createDataFrame([(f"{t}1", t) for t in "ABCD"], "id string, type string")
    bad = h.jobs_without_handler(jobs, versions)
    assert rows(bad, "id", "exitcode", "code") == [(f"{t}1", 500, "BAD_HANDLER") for t in "BCD"]
    left = h.drop_handlers(tr.next_table(put), spark.createDataFrame([("A",)], "type string"))
    assert left.count() == 0


def test_leases(make_jobs, spark, now):
    leases = make_jobs(("s1", "queue.sysid", 1790, "s1"), ("s2", "queue.sysid", 60, "s2"),
                       ("s3", "queue.sysid", -1, "s3"), ("s4", "queue.sysid", -9, ""))
    assert rows(ls.lease_status(leases, now), "id", "status") == [
        ("s1", "live"), ("s2", "degraded"), ("s3", "expired"), ("s4", "expired")]
    one = spark.createDataFrame([("s2",), ("s4",)], "id string")
    assert rows(ls.lease_renew(leases, one, now).where("changed"), "id", "dt") == [
        ("s2", now + dt.timedelta(minutes=30))]
    assert rows(ls.lease_release(leases, one, now).where("changed"), "id", "lock") == [("s2", "")]
    assert rows(tr.affected(ls.lease_expire(leases, now)), "id") == [("s4",)]
    jobs = make_jobs(("a", "t", 1, "s1"), ("b", "t", 1, "s3"), ("c", "t", 1, "gone"), ("d", "t", 1, ""),
                     ("e", "t", 1, "__done"))
    assert rows(ls.jobs_of_dead_owners(jobs, leases, now), "id") == [("b",), ("c",)]


def test_limit_of_a_million(spark):
    jobs = spark.range(2_000_000).select(F.format_string("%08d", F.pmod(F.col("id") * 7919, F.lit(2_000_000))).alias("id"), F.lit("t").alias("type"),
                                         F.current_timestamp().alias("dt"), F.lit("").alias("lock"), F.lit("x").alias("data"))
    got = tr.conditional_update(jobs, F.lit(True), {"lock": F.lit("y")}, limit=1_000_000).where("changed")
    assert got.agg(F.count(F.lit(1)), F.max("id")).first()[:] == (1_000_000, "00999999")


def test_limit_within_equal_and_missing_values(make_jobs, now):
    jobs = make_jobs(*[(f"i{n}", "t", None if n < 3 else 5, "") for n in range(10)])
    for limit in (1, 3, 5, 10, 20):
        got = tr.conditional_update(jobs, F.col("lock") == "", {"lock": F.lit("x")}, limit=limit, order="dt")
        assert got.columns == [*jobs.columns, "changed"] and got.count() == 10
        assert sorted(r["id"] for r in got.where("changed").collect()) == [f"i{n}" for n in range(min(limit, 10))]


def test_a_call_with_one_id_twice(spark):
    jobs = spark.createDataFrame([(1, 0, "a", "t"), (1, 1, "a", "t")], "batch bigint, pos int, id string, type string")
    calls = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 00:00:01", True, False, None, None)],
                                  "batch bigint, started string, stopped string, is_batch boolean, failed boolean, error_code string, status int")
    calls = calls.withColumns({c: F.col(c).cast("timestamp") for c in ("started", "stopped")})
    outputs = spark.createDataFrame([(1, "200 x\n404 y")], "batch bigint, output string")
    got = sorted((r["pos"], r["exitcode"], r["duration"]) for r in outcomes.call_outcomes(jobs, calls, outputs).collect())
    assert got == [(0, 200, 500.0), (1, 404, 500.0)]
