"""Handler versions, their join to jobs, and batches of handler-given size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtide.functions import states
from jobtide.operators.lookup import lookup_join
from jobtide.operators.ordered import number_rows
from jobtide.schema import (CODE_BAD_HANDLER, DEFAULT_BATCH_SIZE, EXIT_ERROR, HANDLER,
                            HANDLER_DROP_BEFORE, HANDLER_DT, LOCK_HANDLER)


def latest_handler(handlers: DataFrame) -> DataFrame:
    """Newest version (largest id) of every type's handler."""
    values = [c for c in handlers.columns if c not in ("id", "type")]
    newest = handlers.groupBy("type").agg(
        F.max("id").alias("id"), F.max_by(F.struct(*values), "id").alias("_h"))
    return newest.select("type", "id", *[F.col(f"_h.{c}").alias(c) for c in values])


def put_handlers(versions: DataFrame) -> DataFrame:
    """New versions as rows of the jobs table; those without lang or body are not accepted."""
    ok = F.coalesce((F.col("lang") != "") & (F.col("body") != ""), F.lit(False))
    fields = [F.col(c) for c in HANDLER.names if c in versions.columns]
    if "batch_size" in versions.columns:
        size = F.when(F.col("batch_size").isNotNull(), F.create_map(F.lit("batchSize"), F.col("batch_size").cast("string")))
        if "options" in versions.columns:  # one field of that name, in which the own column wins
            rest = F.map_filter("options", lambda k, v: (k != "batchSize") | F.col("batch_size").isNull())
            fields = [F.col(c) for c in HANDLER.names if c in versions.columns and c != "options"]
            size = F.coalesce(F.map_concat(rest, size), size, rest)
        fields.append(size.alias("options"))
    return versions.select(
        "id", "type", F.to_timestamp(F.lit(HANDLER_DT)).alias("dt"),
        F.lit(LOCK_HANDLER).alias("lock"), F.to_json(F.struct(*fields)).alias("data"),
        ok.alias("accepted"))


def stored_handlers(jobs: DataFrame) -> DataFrame:
    """The handler versions in a jobs table: id, type, the handler's fields and ``batch_size``.

    A size that is no number gives NULL, and one with a fraction its whole part.
    """
    rows = jobs.where(F.col("lock") == LOCK_HANDLER).select(
        "id", "type", F.from_json("data", HANDLER).alias("_h"))
    return rows.select("id", "type", "_h.*", F.col("_h.options")["batchSize"].try_cast("double").try_cast("int")
                       .alias("batch_size"))


def drop_handlers(jobs: DataFrame, types: DataFrame) -> DataFrame:
    """The table without any handler version of the given types."""
    gone = types.select("type").distinct()
    fixed = F.col("dt") < F.to_timestamp(F.lit(HANDLER_DROP_BEFORE))
    droppable = (F.col("lock") == LOCK_HANDLER) & fixed
    kept = jobs.where(~F.coalesce(droppable, F.lit(False)))
    left = lookup_join(jobs.where(droppable), gone, "type", "id", "left_anti")
    return kept.unionByName(left.select(*jobs.columns))


def attach_handlers(jobs: DataFrame, handlers: DataFrame) -> DataFrame:
    """Every job with the newest handler of its type, NULLs when there is none."""
    newest = latest_handler(handlers).withColumnRenamed("id", "handler_id")
    return lookup_join(jobs, newest, "type", "id")


def jobs_without_handler(jobs: DataFrame, handlers: DataFrame) -> DataFrame:
    """Jobs that cannot run: their type's newest handler is missing or lacks lang or body."""
    usable = latest_handler(handlers).where("lang <> '' AND body <> ''").select("type")
    return lookup_join(jobs, usable, "type", "id", "left_anti").select(
        "id", "type", F.lit(EXIT_ERROR).alias("exitcode"), F.lit(CODE_BAD_HANDLER).alias("code"))


def assign_batches(jobs: DataFrame, handlers: DataFrame,
                   default_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Cuts each type's jobs, in id order, in batches of the handler's size: (batch_no, pos)."""
    numbered = number_rows(jobs.select("type", "id"), ["type"], ["id"], "_n")
    sizes = latest_handler(handlers.select("id", "type", "batch_size")).select("type", "batch_size")
    size = F.coalesce(states.batch_limit(F.col("batch_size")), F.lit(default_size)).cast("long")
    return lookup_join(numbered, sizes, "type", "id").select(
        "type", "id", F.floor((F.col("_n") - 1) / size).alias("batch_no"),
        ((F.col("_n") - 1) % size).alias("pos"))
