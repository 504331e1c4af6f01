"""Running a stream over what is there now, to a folder, and reading its counts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from jobtide.session import work_path


def _start(writer, checkpoint: str) -> StreamingQuery:
    query = (writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def drain_to_folder(stream: DataFrame, label: str, checkpoint: str | None = None,
                    path: str | None = None) -> DataFrame:
    """Appends all available results to a folder of the shared root and reads the folder."""
    spark = stream.sparkSession
    path = path or work_path(spark, label)
    _start(stream.writeStream.format("parquet").outputMode("append").option("path", path),
           checkpoint or work_path(spark, f"{label}-offsets"))
    return spark.read.schema(stream.schema).parquet(path)


class StatsHook:
    """Hands statistics of a stream to an emitter, a function of (name, micro-batch, DataFrame).

    ``configure`` replaces the emitter, also while the stream runs: the next micro-batch goes to the new one.
    """

    def __init__(self, emitter: Callable[[str, int, DataFrame], None]):
        self.emitter = emitter

    def configure(self, emitter: Callable[[str, int, DataFrame], None]) -> None:
        self.emitter = emitter

    def emit(self, name: str, batch_id: int, stats: DataFrame) -> None:
        self.emitter(name, batch_id, stats)


class StatsTable:
    """An emitter that keeps statistics as a table, one folder per name and micro-batch; a replay overwrites its own."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, name: str, batch_id: int, stats: DataFrame) -> None:
        stats.write.mode("overwrite").parquet(f"{self.path}/name={name}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class ObservedSums(StreamingQueryListener):
    """Sums of a stream's ``observe`` metrics over all its micro-batches, by the name observed.

    ``with ObservedSums(spark, "name") as seen:`` around a drain; ``seen.sums`` has them afterwards.
    A query's own ``recentProgress`` keeps only the last hundred micro-batches.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.sums, self.batches = spark, name, {}, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches += 1
            for field, value in row.asDict().items():
                self.sums[field] = self.sums.get(field, 0) + (value or 0)

    def __enter__(self) -> ObservedSums:
        self.ended = False
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        until = time.monotonic() + 30
        while not self.ended and not any(error) and time.monotonic() < until:  # events come after the query's end
            time.sleep(0.05)
        self.spark.streams.removeListener(self)


def drain_to(stream: DataFrame, sink, label: str, checkpoint: str | None = None) -> StreamingQuery:
    """Feeds all available micro-batches to a ``foreachBatch`` sink."""
    return _start(stream.writeStream.foreachBatch(sink),
                  checkpoint or work_path(stream.sparkSession, f"{label}-offsets"))
