"""Job state, completion time and outcome classes as column expressions.

Lock tests are null-safe: a missing lock counts as locked when locks are broken and as not
waiting when jobs are picked.
"""

from __future__ import annotations

import datetime as dt_

from pyspark.sql import Column, functions as F

from jobtide.schema import ARCHIVE_YEARS, LOCK_DONE, LOCK_HANDLER, LOCK_NONE, TYPE_LEASE


def instant(now) -> Column:
    """``now`` as a timestamp column: a datetime (UTC when naive), text, epoch ms or a column."""
    if isinstance(now, Column):
        return now
    if isinstance(now, int):
        return F.timestamp_millis(F.lit(now).cast("long"))
    if isinstance(now, dt_.datetime):
        if now.tzinfo is None:
            now = now.replace(tzinfo=dt_.timezone.utc)
        now = (now - dt_.datetime(1970, 1, 1, tzinfo=dt_.timezone.utc)) // dt_.timedelta(microseconds=1)
        return F.timestamp_micros(F.lit(now).cast("long"))
    return F.to_timestamp(F.lit(now))


def plus_ms(ts: Column, ms) -> Column:
    ms = ms if isinstance(ms, Column) else F.lit(ms)
    return F.timestamp_micros(F.unix_micros(ts) + ms.cast("long") * 1000)


def is_unlocked(lock: Column) -> Column:
    return lock.eqNullSafe(F.lit(LOCK_NONE))


def is_ready(dt: Column, lock: Column, now) -> Column:
    return is_unlocked(lock) & (dt <= instant(now))


def is_stale(dt: Column, lock: Column, now) -> Column:
    """Locked and strictly past its time."""
    return ~is_unlocked(lock) & (dt < instant(now))


def is_running_lock(lock: Column) -> Column:
    return ~F.coalesce(lock.isin(LOCK_NONE, LOCK_DONE, LOCK_HANDLER), F.lit(False))


def is_lease(type_col: Column) -> Column:
    return type_col.eqNullSafe(F.lit(TYPE_LEASE))


def job_state(dt: Column, lock: Column, now) -> Column:
    now = instant(now)
    return (F.when(is_unlocked(lock) & (dt > now), "deferred")
            .when(is_unlocked(lock), "ready")
            .when(lock == LOCK_DONE, "done")
            .when(lock == LOCK_HANDLER, "handler")
            .when(dt < now, "abandoned")
            .otherwise("running"))


def lock_class(lock: Column) -> Column:
    """Partition key of stored job tables: what claim, upkeep and purge read apart."""
    return (F.when(is_unlocked(lock), "open")
            .when(lock == LOCK_DONE, "done")
            .when(lock == LOCK_HANDLER, "handler")
            .otherwise("held"))


def archive_dt(done: Column) -> Column:
    return done + F.expr(f"INTERVAL {ARCHIVE_YEARS} YEARS")


def done_at(dt: Column) -> Column:
    """Completion time of an archived job."""
    return dt - F.expr(f"INTERVAL {ARCHIVE_YEARS} YEARS")


def outcome_class(exitcode: Column) -> Column:
    hundred = F.floor(exitcode / 100)
    return (F.when(hundred == 1, "retry").when(hundred == 2, "ok")
            .when(hundred == 4, "failed").when(hundred == 5, "error")
            .otherwise("other"))


def is_final(exitcode: Column) -> Column:
    """2xx and 4xx end a job; everything else, a missing code included, is tried again."""
    return F.coalesce(F.floor(exitcode / 100).isin(2, 4), F.lit(False))


def batch_limit(size: Column) -> Column:
    """A handler's batch size; NULL (take the default) unless it is at least 1."""
    return F.when(size > 0, size)
