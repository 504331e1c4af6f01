"""Outcome windows, handlers and retries on streams of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtide.functions import states
from jobtide.operators.handlers import latest_handler
from jobtide.operators.lookup import dealt_lookup
from jobtide.schema import RETRY_DELAY_MS


def stream_outcome_windows(runs: DataFrame, delay: str = "10 minutes",
                           width: str = "1 minute") -> DataFrame:
    """Runs per type, outcome class and minute of stopping; later rows than ``delay`` are dropped."""
    return (runs.withWatermark("stopped", delay)
            .groupBy(F.window("stopped", width).alias("w"), "type",
                     states.outcome_class(F.col("exitcode")).alias("class"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_millis("w.start").alias("window_ms"), "type", "class", "n"))


def stream_attach_handlers(jobs: DataFrame, handlers: DataFrame, parts: int = 32) -> DataFrame:
    """A stream of jobs with the newest handler of each job's type, read anew per micro-batch.

    Handlers too big to broadcast are joined with every type dealt over ``parts``.
    """
    newest = latest_handler(handlers).select(
        "type", F.col("id").alias("handler_id"), "lang", "body")
    return dealt_lookup(jobs, newest, "type", "id", parts)


def stream_retry_ready(releases: DataFrame, runs: DataFrame, bound: str = "10 minutes",
                       delay: str = "30 minutes") -> DataFrame:
    """Retried jobs (id, attempt, released) with the job's next run, or NULLs if none comes within ``bound``.

    The next run is the first of a later attempt that starts at or after the release. A release comes out once, when
    the watermark has passed all the runs that it may meet; rows of more than ``delay`` are late. ``ready_ms`` is
    when the retry was due, ``early`` whether the run began before that.
    """
    left = releases.withWatermark("released", delay).select(
        F.col("id").alias("r_id"), F.col("attempt").alias("r_attempt"), "released")
    right = runs.withWatermark("started", delay).select("id", "started", "attempt")
    met = left.join(right, (F.col("r_id") == F.col("id")) & (F.col("attempt") > F.col("r_attempt"))
                    & (F.col("started") >= F.col("released"))
                    & (F.col("started") <= F.col("released") + F.expr(f"INTERVAL {bound}")), "left_outer")
    run = F.when(F.col("id").isNotNull(), F.struct("started", "attempt"))
    first = met.groupBy("released", "r_id", "r_attempt").agg(F.min(run).alias("run"))
    due = states.plus_ms(F.col("released"), RETRY_DELAY_MS)
    return first.select(
        F.col("r_id").alias("id"), F.col("r_attempt").alias("attempt"), F.col("run.attempt").alias("next_attempt"),
        F.unix_millis("released").alias("released_ms"), F.unix_millis(due).alias("ready_ms"),
        F.unix_millis("run.started").alias("started_ms"), (F.col("run.started") < due).alias("early"))
