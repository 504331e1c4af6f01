"""JSON log lines to columns, and the level filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobtide.schema import LOG_LINE

# Rank of each level name; the default threshold is INFO.
LEVEL_RANK = {"EMERG": 0, "CRIT": 1, "ALERT": 2, "ERROR": 3, "WARN": 4, "INFO": 6, "DEBUG": 7,
              "TRACE": 8}
DEFAULT_LEVEL = "INFO"


def log_scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Log lines as columns; ``bad_line`` holds a line that is no JSON log line, else NULL."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return parse_log_lines(lines.withColumnRenamed("value", "line"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    schema = T.StructType([*LOG_LINE.fields, T.StructField("bad_line", T.StringType())])
    parsed = F.from_json("line", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"})
    return lines.select(parsed.alias("_r")).select("_r.*")


def log_level_filter(logs: DataFrame, threshold: str = DEFAULT_LEVEL) -> DataFrame:
    """Lines at or above ``threshold`` in importance, by level name in either case.

    A level without a rank is not held back. Lines that are no log lines have no level; they are in
    :func:`log_rejects`.
    """
    rank = F.create_map(*[F.lit(x) for item in LEVEL_RANK.items() for x in item])
    important = F.coalesce(F.try_element_at(rank, F.upper("type")) <= LEVEL_RANK[threshold.upper()], F.lit(True))
    return logs.where(important & F.col("bad_line").isNull())


def log_rejects(logs: DataFrame) -> DataFrame:
    """The lines that are no JSON log lines."""
    return logs.where(F.col("bad_line").isNotNull()).select(F.col("bad_line").alias("line"))
