"""Interval schedules (schedule_id, interval, start_ms) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtide.functions import text

_CHUNK = 1000  # least firings per array


def _now_ms(now_ms: int):
    return F.lit(now_ms).cast("long")


def schedule_next_run(schedules: DataFrame, now_ms: int) -> DataFrame:
    """Adds ``interval_ms`` and the first firing after ``now_ms``; ``ok`` is false for bad text.

    A schedule fires an interval after its start at the earliest, not at the start itself.
    """
    every = F.col("interval_ms")
    # The interval divides the time since the start; zero intervals never fire.
    into = F.pmod(_now_ms(now_ms) - F.col("start_ms"), every)
    return (schedules.withColumn("interval_ms", text.interval_ms(F.col("interval")))
            .withColumn("next_ms", F.when(every > 0, F.greatest(F.col("start_ms") + every,
                                                                _now_ms(now_ms) + every - into)))
            .withColumn("ok", every.isNotNull()))


def schedule_due(planned: DataFrame, now_ms: int) -> DataFrame:
    """Schedules whose next run has come."""
    return planned.where(F.col("next_ms") <= now_ms)


def schedule_expand(schedules: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Every firing in [from_ms, to_ms): (schedule_id, fire_ms).

    A schedule is expanded to chunks, which are spread over the tasks, and these to firings. A
    chunk has about the root of the number of firings, so neither array gets huge.
    """
    plan = schedule_next_run(schedules, from_ms - 1).where(F.col("next_ms") < to_ms)
    count = F.floor((F.lit(to_ms - 1) - F.col("next_ms")) / F.col("interval_ms")) + 1
    size = F.greatest(F.lit(_CHUNK).cast("long"), F.ceil(F.sqrt("_count")))
    chunks = plan.withColumn("_count", count).withColumn("_size", size).select(
        "schedule_id", "interval_ms", "next_ms", "_count", "_size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / F.col("_size"))))
        .alias("_chunk")).repartition("schedule_id", "_chunk")
    first = F.col("_chunk") * F.col("_size")
    last = F.least(first + F.col("_size"), F.col("_count")) - 1
    return chunks.select("schedule_id", "interval_ms", "next_ms",
                         F.explode(F.sequence(first, last)).alias("_k")).select(
        "schedule_id", (F.col("next_ms") + F.col("_k") * F.col("interval_ms")).alias("fire_ms"))
