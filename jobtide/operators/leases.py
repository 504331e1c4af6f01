"""System-id leases: job rows of a reserved type, locked by their own id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtide.functions import states
from jobtide.operators.lookup import lookup_join
from jobtide.operators.transitions import purge_jobs, release_jobs, renew_locks
from jobtide.schema import LEASE_DEGRADED_MS, LEASE_MS, LOCK_NONE, TYPE_LEASE


def lease_status(leases: DataFrame, now, lease_ms: int = LEASE_MS,
                 degraded_ms: int = LEASE_DEGRADED_MS) -> DataFrame:
    """live, degraded (not renewed for over a minute) or expired, with the milliseconds left."""
    left = F.unix_millis("dt") - F.unix_millis(states.instant(now))
    status = (F.when(states.is_unlocked(F.col("lock")) | (left < 0), "expired")
              .when(left < lease_ms - degraded_ms, "degraded").otherwise("live"))
    return leases.select("id", status.alias("status"), left.alias("left_ms"))


def lease_renew(leases: DataFrame, sysids: DataFrame, now, lease_ms: int = LEASE_MS) -> DataFrame:
    """Sets the leases of ``sysids`` (id) that they still hold to run ``lease_ms`` more."""
    return renew_locks(leases, sysids.select("id", F.col("id").alias("lock")), now, lease_ms)


def lease_release(leases: DataFrame, sysids: DataFrame, now) -> DataFrame:
    """Unlocks the leases of ``sysids`` (id) at once."""
    return release_jobs(leases, sysids.select(
        "id", F.col("id").alias("lock"), F.lit("unget").alias("how")), now)


def lease_expire(leases: DataFrame, now) -> DataFrame:
    """Removes unlocked leases older than ``now``."""
    return purge_jobs(leases, now, type=TYPE_LEASE, lock=LOCK_NONE)


def jobs_of_dead_owners(jobs: DataFrame, leases: DataFrame, now) -> DataFrame:
    """Jobs under the lock of a daemon that has no live lease."""
    alive = leases.where(~states.is_unlocked(F.col("lock"))
                         & (F.col("dt") >= states.instant(now))).select("lock").distinct()
    owned = jobs.where(states.is_running_lock(F.col("lock")) & ~states.is_lease(F.col("type")))
    return lookup_join(owned, alive, "lock", "id", "left_anti")
