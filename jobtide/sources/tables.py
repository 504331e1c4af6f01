"""Job tables on storage: folders by lock class and by the day that a job's id tells.

Claims read ``open`` jobs, lock upkeep ``held`` ones and purges ``done`` ones, so each reads its
folders only; what looks for an id reads the days of the ids it has. New jobs are added as files of their
own in those folders, and all other files stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.functions import ids, states
from jobtide.operators.transitions import add_jobs, first_per_id, next_table, unknown_rows
from jobtide.schema import JOB
from jobtide.session import cut

CLASS, DAY = "lock_class", "created_day"
_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in JOB.fields)
_SCHEMA = f"{_COLUMNS}, {CLASS} string, {DAY} date"


def _placed(jobs: DataFrame) -> DataFrame:
    return jobs.select(*JOB.names, states.lock_class(F.col("lock")).alias(CLASS), ids.created_day(F.col("id")).alias(DAY))


def _write(placed: DataFrame, path: str, mode: str) -> None:
    # One day's rows go to few files, a day with most of the rows to several.
    placed.hint("rebalance", CLASS, DAY).write.mode(mode).partitionBy(CLASS, DAY).parquet(path)


def write_snapshot(jobs: DataFrame, path: str) -> None:
    _write(_placed(jobs), path, "error")


def create_snapshot(spark: SparkSession, path: str) -> None:
    """An empty table, unless something is there."""
    _write(_placed(spark.createDataFrame([], JOB)), path, "ignore")


def read_days(spark: SparkSession, path: str, *classes: str) -> DataFrame:
    """As :func:`read_snapshot`, with the day of each job's id, by which the folders are laid out."""
    df = spark.read.schema(_SCHEMA).parquet(path)
    if classes:
        df = df.where(F.col(CLASS).isin(*classes))
    return df.drop(CLASS)


def read_snapshot(spark: SparkSession, path: str, *classes: str) -> DataFrame:
    """The jobs of a snapshot, or those of some lock classes (open, held, done, handler)."""
    return read_days(spark, path, *classes).drop(DAY)


def add_new(spark: SparkSession, path: str, rows: DataFrame, order: list[str]) -> None:
    """Adds the rows with new ids to the snapshot at ``path``; of rows with one id the first in ``order``.

    Ids are looked for in the folders of the rows' own days only, and what is new is written once,
    beside what is there, so the cost goes with the rows and their days, not with the table. A repetition after a
    failure finds what was added before and adds the rest.
    """
    fresh = cut(first_per_id(rows.select(*JOB.names), order), "fresh")
    new = cut(unknown_rows(read_days(spark, path), fresh, DAY), "new")
    if not new.isEmpty():
        _write(_placed(new), path, "append")


def jobs_upsert(spark: SparkSession, path: str, rows: DataFrame, now, order: list[str]) -> None:
    """Adds the accepted rows with new ids to the snapshot at ``path``, see :func:`add_new`."""
    add_new(spark, path, next_table(add_jobs(rows, now)), order)
