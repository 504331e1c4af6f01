"""Journal files: text, one ``id|type|payload`` line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Lines end at a newline only: a carriage return is part of its line (and makes it a reject),
# while the text source would end lines at it by default.
_LINE_SEP = "\n"


def journal_scan(spark: SparkSession, *paths: str) -> DataFrame:
    return (spark.read.option("lineSep", _LINE_SEP).text(list(paths))
            .withColumnRenamed("value", "line"))


def journal_stream(spark: SparkSession, path: str, max_files: int | None = None,
                   max_bytes: str | None = None) -> DataFrame:
    """Lines of new files in a folder; ``max_files`` or ``max_bytes`` bound a micro-batch."""
    reader = spark.readStream.option("lineSep", _LINE_SEP)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.text(path).withColumnRenamed("value", "line")


def journal_append(lines: DataFrame, path: str, line: str = "line") -> int:
    """Appends the non-empty lines and returns their number, counted by the write itself."""
    counted = Observation()
    (lines.where(F.col(line) != "").select(F.col(line).alias("value"))
     .observe(counted, F.count(F.lit(1)).alias("n"))
     .write.mode("append").option("lineSep", _LINE_SEP).text(path))
    return counted.get["n"]


def journal_write(lines: DataFrame, path: str, line: str = "line") -> None:
    """Writes the lines as they are, blank ones included, as a new journal."""
    (lines.select(F.col(line).alias("value")).write.option("lineSep", _LINE_SEP).text(path))


def journal_compact(spark: SparkSession, sources: list[str], target: str) -> None:
    """Joins many small files into bigger ones; the inputs stay, to be removed once the target is in use.

    The lines are rebalanced to files of about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``,
    so their number follows the size of the journal.
    """
    lines = journal_scan(spark, *sources).withColumnRenamed("line", "value")
    lines.hint("rebalance").write.option("lineSep", _LINE_SEP).text(target)
