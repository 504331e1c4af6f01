"""What must hold for any table: limits, untouched rows, nothing lost."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jobtide.functions import states
from jobtide.operators import transitions as tr
from jobtide.plans import feeds


@pytest.fixture(scope="module")
def jobs(make_jobs):
    rng = random.Random(3)
    types = ["hot"] * 6 + ["a", "b", "c"]
    locks = ["", "", "", "me", "you", "__done", "__handler", None]
    return make_jobs(*[(f"{i:05}", rng.choice(types), rng.randint(-50, 50), rng.choice(locks))
                       for i in rng.sample(range(100_000), 800)]).cache()


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_claims(jobs, now, limit):
    got = tr.claim_jobs(jobs, now, "new", limit)
    ready = jobs.where(states.is_ready(F.col("dt"), F.col("lock"), now))
    want = {(r["type"], r["id"]) for t in ("hot", "a", "b", "c")
            for r in ready.where(F.col("type") == t).orderBy("id").limit(limit).collect()}
    assert {(r["type"], r["id"]) for r in got.where("changed").collect()} == want
    same = got.where("NOT changed").drop("changed")
    assert same.exceptAll(jobs).count() == 0 and got.count() == jobs.count()
    assert not tr.claim_jobs(tr.next_table(got), now, "next", limit).where(
        "changed").join(got.where("changed"), "id").count()


def test_no_row_is_lost(jobs, now):
    for flagged in (tr.purge_jobs(jobs, now, lock=""), tr.purge_done(jobs, now, 0),
                    tr.conditional_update(jobs, F.col("type") == "hot", remove=True, limit=50)):
        assert tr.next_table(flagged).count() + tr.affected(flagged).count() == jobs.count()
        assert tr.next_table(flagged).exceptAll(jobs).count() == 0


def test_expired_locks_are_ready_and_stay_so(jobs, now):
    once = tr.next_table(tr.expire_locks(jobs, now))
    assert once.where(states.is_stale(F.col("dt"), F.col("lock"), now)).count() == 0
    assert tr.expire_locks(once, now).where("changed").count() == 0


def test_upsert_twice_is_once(spark, jobs, now):
    half = jobs.where("id < '50000'")
    once = tr.add_jobs_unique(half, jobs, now, ["dt"])
    assert sorted(r["id"] for r in once.collect()) == sorted(r["id"] for r in jobs.collect())
    assert tr.add_jobs_unique(once, jobs, now, ["dt"]).exceptAll(once).count() == 0


def test_journal_round_trip(spark):
    from jobtide.operators import journal_ops
    events = feeds.table(spark, "/root/testdata/sf0.001", "events")
    jobs = feeds.jobs_from(events).select("id", "type", "data")
    lines = jobs.select(F.concat_ws("|", "id", "type", "data").alias("line"))
    assert journal_ops.journal_parse(lines).select("id", "type", "data").exceptAll(jobs).count() == 0
    assert journal_ops.journal_rejects(lines).count() == 0
