"""Session helpers: the shared work folder and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors see.

    Only a local-mode session may go without it; it then gets a temporary folder once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="jobtide-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; retention is left to the folder's owner."""
    return f"{shared_root(spark).rstrip('/')}/jobtide/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    A lost executor re-reads files instead of recomputing, values that depend on the physical
    partition stay what they were, and later joins see the true size. ``options`` are the writer's.
    """
    path = work_path(df.sparkSession, label)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run inside hands rows to Python in Arrow batches that end at ``size`` bytes; a larger row is a batch.

    Spark holds a batch three times (vectors, which double as they grow, and the stream's buffer), all outside its heap.
    """
    held = spark.conf.getAll.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, size)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, held)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate lets it broadcast ``df`` by itself."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="jobtide-"), "jobtide_package")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "jobtide"))
    _shipped.add(app)
