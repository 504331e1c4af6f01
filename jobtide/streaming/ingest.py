"""Journal lines to the jobs table, continuously."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobtide.operators.journal_ops import ingest_counts, journal_parse
from jobtide.operators.transitions import add_jobs, next_table
from jobtide.sources import tables
from jobtide.streaming.run import StatsHook


def stream_ingest(lines: DataFrame) -> DataFrame:
    """Parsed jobs of a line stream, at least once; the checkpoint keeps the read position."""
    return journal_parse(lines)


class UniqueSink:
    """``foreachBatch`` writer of each job once, whenever and however often its copies come.

    A micro-batch keeps one row an id, looks for the ids in the stored folders of their own days and adds what is
    not there, so nothing is held between batches, no copy is too late, and the result is the same at any
    speed and cut of the stream. What is written is proportional to what comes in. A replayed batch, another
    checkpoint or another query on the same table finds its jobs stored and adds only what is missing; one
    writer at a time.
    """

    def __init__(self, path: str, order: list[str]):
        self.path, self.order, self.there = path.rstrip("/"), order, False

    def accepted(self, rows: DataFrame) -> DataFrame:
        return rows

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if not self.there:
            tables.create_snapshot(spark, self.path)
            self.there = True
        tables.add_new(spark, self.path, self.accepted(rows), self.order)

    def read(self, spark: SparkSession) -> DataFrame:
        return tables.read_snapshot(spark, self.path)


class UpsertSink(UniqueSink):
    """:class:`UniqueSink` for the jobs table: rows without id or type are refused, a missing dt is ``now``."""

    def __init__(self, path: str, now, order: list[str]):
        super().__init__(path, order)
        self.now = now

    def accepted(self, rows: DataFrame) -> DataFrame:
        return next_table(add_jobs(rows, self.now))


def ingest_with_stats(sink: Callable[[DataFrame, int], None], hook: StatsHook) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over lines: jobs go to ``sink``, then the batch's counts to ``hook``."""
    def ingest(lines: DataFrame, batch_id: int) -> None:
        lines = lines.persist()
        try:
            sink(stream_ingest(lines), batch_id)
            hook.emit("ingestJournal", batch_id, ingest_counts(lines))
        finally:
            lines.unpersist()

    return ingest
