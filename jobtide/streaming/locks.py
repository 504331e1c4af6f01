"""Stale locks and running counts on event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.operators.concurrency import ORDER, _COLS
from jobtide.operators.ordered import clamp_summary
from jobtide.schema import LOCK_EXPIRE_MS


def stream_lock_expiry(events: DataFrame, delay: str = "10 minutes",
                       expire_ms: int = LOCK_EXPIRE_MS) -> DataFrame:
    """Abandoned jobs: no claim, renewal or stop (id, lock, kind, ev_at) within the lock time.

    Each event keeps its lock's session open for the lock time; a session that closes on anything
    but a stop was abandoned, so a claim after a stop counts again. Of events at one time a stop is
    the last. An event exactly at the end still counts, as locks break strictly after.
    """
    gap = f"{expire_ms} milliseconds"
    return (events.withWatermark("ev_at", delay)
            .groupBy(F.session_window("ev_at", gap).alias("w"), "id", "lock")
            .agg(F.max_by("kind", F.struct("ev_at", F.col("kind") == "stop")).alias("last"), F.count(F.lit(1)).alias("events"))
            .where("last <> 'stop'")
            .select("id", "lock", F.unix_millis("w.start").alias("claimed_ms"),
                    F.unix_millis("w.end").alias("expired_ms"), "events"))


class RunningCounts:
    """``foreachBatch`` keeper of the running count (never below zero) and the starts per type.

    A micro-batch is summed up per type as (total, least running sum) by slices, so no task sees
    all events of a type; the state is one row per type. Every batch writes its own version from
    the one before, so a replay gives the same state.
    """

    _STATE = "type string, x bigint, started_total bigint"

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _version(self, batch_id: int) -> str:
        return f"{self.path}/version={batch_id}"

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        summary = clamp_summary(events.select(*_COLS), ["type"], ORDER, "d")
        before = (spark.read.schema(self._STATE).parquet(self._version(batch_id - 1))
                  if batch_id > 0 else spark.createDataFrame([], self._STATE))

        def known(c):
            return F.coalesce(c, F.lit(0))

        x, total, low = known("x"), known("total"), known("low")
        after = before.join(summary, "type", "full").select(
            "type", (x + total - F.least(F.lit(0), x + low)).cast("long").alias("x"),
            (known("started_total") + known("gained")).cast("long").alias("started_total"))
        after.write.mode("overwrite").parquet(self._version(batch_id))

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Counts after a batch; types at zero are idle."""
        return spark.read.schema(self._STATE).parquet(self._version(batch_id))
