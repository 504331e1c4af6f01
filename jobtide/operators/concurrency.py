"""Running counts over start and stop events (type, id, attempt, ev_at, kind, d)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtide.operators.ordered import clamp_summary, clamped_counts, running_sums

ORDER = ["ev_at", "kind", "id", "attempt"]
_COLS = ["type", *ORDER, "d"]


def running_counts(events: DataFrame) -> DataFrame:
    """Running jobs of a type after each of its events, never below zero (``x``)."""
    return clamped_counts(events.select(*_COLS), ["type"], ORDER, "d")


def idle_types(events: DataFrame) -> DataFrame:
    """Types and their final count, with ``idle`` set where nothing runs any more."""
    end = clamp_summary(events.select(*_COLS), ["type"], ORDER, "d")
    return end.select("type", (F.col("total") - F.col("low")).alias("x")).withColumn(
        "idle", F.col("x") <= 0)


def running_totals(events: DataFrame) -> DataFrame:
    """Over all types after each event: jobs started, jobs running (unclamped), active types."""
    per_type = running_counts(events)
    active = (F.col("x") > 0).cast("long") - (F.col("x_before") > 0).cast("long")
    return running_sums(per_type, [], ORDER, {
        "started_total": F.greatest(F.col("d"), F.lit(0)),
        "running_total": F.col("d"),
        "active_types": active,
    }).select("type", *ORDER, "started_total", "running_total", "active_types")
