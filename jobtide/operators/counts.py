"""Counts and groupings over job tables.

All of them aggregate partially before the shuffle, so a type with most of the rows costs one
partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.functions import states, text
from jobtide.operators.ordered import number_rows


def _user_jobs(jobs: DataFrame, include_system: bool) -> DataFrame:
    return jobs if include_system else jobs.where(~states.is_lease(F.col("type")))


def waiting_jobs(jobs: DataFrame, now, include_system: bool = False) -> DataFrame:
    return _user_jobs(jobs, include_system).where(
        states.is_ready(F.col("dt"), F.col("lock"), now))


def waiting_counts(jobs: DataFrame, now, include_system: bool = False) -> DataFrame:
    return waiting_jobs(jobs, now, include_system).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"))


def waiting_types(jobs: DataFrame, now, include_system: bool = False) -> DataFrame:
    return waiting_jobs(jobs, now, include_system).select("type").distinct()


def running_types(jobs: DataFrame, include_system: bool = False) -> DataFrame:
    """Types with a job under a daemon's lock, whatever its time."""
    return (_user_jobs(jobs, include_system)
            .where(states.is_running_lock(F.col("lock"))).select("type").distinct())


def state_counts(jobs: DataFrame, now) -> DataFrame:
    state = states.job_state(F.col("dt"), F.col("lock"), now).alias("state")
    return jobs.groupBy("type", state).agg(F.count(F.lit(1)).alias("n"))


def state_rollup(jobs: DataFrame, now) -> DataFrame:
    """State counts per tenant and job type, with totals per tenant and over all (NULLs).

    ``level`` tells a total (1: of a tenant, 3: of a state) from a type without a dash, whose job
    type is NULL as well (0).
    """
    return (state_counts(jobs, now)
            .select("state", "n", text.tenant(F.col("type")).alias("tenant"),
                    text.jobtype(F.col("type")).alias("jobtype"))
            .rollup("state", "tenant", "jobtype").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
            .where("level < 7"))


def select_field(rows: DataFrame, field: str, out: str = "value") -> DataFrame:
    """One column of all rows; a column that is not there gives NULLs."""
    col = F.col(field) if field in rows.columns else F.lit(None).cast("string")
    return rows.select(col.alias(out))


def mask_fields(rows: DataFrame, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """Only the named columns, NULL where missing, besides the key columns in ``keep``."""
    return rows.select(*keep, *[
        F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])


def uniq(rows: DataFrame, value: Column) -> DataFrame:
    """Distinct values, as text."""
    return rows.select(value.cast("string").alias("value")).distinct()


def group_by_field(rows: DataFrame, by: Column, order: list[str]) -> DataFrame:
    """Rows put in groups: (grp, pos, order columns), ``pos`` counting from 0 in each group.

    Groups stay rows, never one array, so a group may be of any size.
    """
    keyed = rows.select(by.cast("string").alias("grp"), *order)
    return number_rows(keyed, ["grp"], order, "_n").select(
        "grp", (F.col("_n") - 1).alias("pos"), *order)


def count_by_field(rows: DataFrame, by: Column) -> DataFrame:
    return rows.groupBy(by.cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def stats_sum(stats: DataFrame) -> DataFrame:
    return stats.groupBy("name").agg(F.sum("value").alias("total"))


def stats_events(events: DataFrame) -> DataFrame:
    """Jobs per lifecycle event name and type, from events (name, type, ids)."""
    return events.groupBy("name", "type").agg(F.sum(F.size("ids")).alias("n"))


def _events(rows: DataFrame, name: Column, value: Column) -> DataFrame:
    return rows.select(name.alias("name"), "type", F.array("id").alias("ids"), value.cast("bigint").alias("value"))


# The names of the lifecycle events.
RUN_EVENTS = {"archive": "archiveJobs", "retry": "retryJobs", "abandon": "abandonJobs"}
UPKEEP_EVENTS = {"renew": "renewLocks", "expire": "expireLocks", "purge_done": "expireJobs", "purge_unrun": "expireJobs"}


def _named(names: dict[str, str], key: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(key)]


def run_events(decided: DataFrame) -> DataFrame:
    """Events of runs (id, type, action, run_ms): one of the start, worth 1, and one of the end, worth the run's time."""
    both = decided.select("id", "type", F.explode(F.array(
        F.struct(F.lit("runNewJobs").alias("name"), F.lit(1).cast("bigint").alias("value")),
        F.struct(_named(RUN_EVENTS, "action").alias("name"), F.col("run_ms").cast("bigint").alias("value")))).alias("e"))
    return _events(both, F.col("e.name"), F.col("e.value"))


def upkeep_events(kept: DataFrame) -> DataFrame:
    """Events of a table that :func:`upkeep` flagged: one per renewed, expired or removed job, in that one pass."""
    return _events(kept.where(F.col("action").isNotNull()), _named(UPKEEP_EVENTS, "action"), F.lit(1))


def ingest_events(jobs: DataFrame) -> DataFrame:
    """One event per ingested job."""
    return _events(jobs, F.lit("ingestJournal"), F.lit(1))


def stats_totals(emitted: DataFrame) -> DataFrame:
    """Emitted ingest statistics (kind, type, n of each micro-batch), added up."""
    return emitted.groupBy("kind", "type").agg(F.sum("n").alias("n"))


def stopped_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(runs: DataFrame) -> DataFrame:
    """Runs per type and outcome class, with the share of runs that went well."""
    kind = states.outcome_class(F.col("exitcode"))
    names = ["retry", "ok", "failed", "error", "other"]
    counted = runs.groupBy("type").agg(
        *[F.count_if(kind == n).alias(n) for n in names], F.count(F.lit(1)).alias("runs"))
    return counted.withColumn("success_rate", F.col("ok") / F.col("runs"))
