"""Joining a table to a side with one row per key, whatever the size of that side and the skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.session import cut, fits_broadcast

ROWS_PER_PART = 1_000_000


def lookup_join(rows: DataFrame, side: DataFrame, key: str, spread: str, how: str = "left",
                rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``rows`` joined to ``side`` (one row per ``key``) by an inner, left, semi or anti join.

    A side that fits is broadcast by the optimizer and the rows stay where they are. A bigger one
    is joined by shuffle: the keys are then counted, the rows of every key with more than
    ``rows_per_part`` dealt over as many parts as its count asks for (by ``spread``, a column that
    differs within a key), and its one side row copied to each part. There are at most as many such
    keys as parts of that size, however many keys there are. All keys stay whole in the result.
    """
    extra = [] if how in ("left_semi", "left_anti") else [c for c in side.columns if c != key]
    if fits_broadcast(side):
        return rows.join(side, key, how).select(*rows.columns, *extra)
    counted = (rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
               .where(F.col("_rows") > rows_per_part)
               .select(key, F.ceil(F.col("_rows") / rows_per_part).alias("_parts")))
    hot = cut(counted, "hot-keys")  # few rows, written so that their true size decides the join
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts))
    copied = side.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return (dealt.drop("_parts").join(copied, [key, "_part"], how)
            .select(*rows.columns, *extra))


def dealt_lookup(rows: DataFrame, side: DataFrame, key: str, spread: str, parts: int) -> DataFrame:
    """Left join like :func:`lookup_join` for streams, whose keys cannot be counted beforehand:
    beyond broadcast size every key is dealt over ``parts``."""
    columns = [*rows.columns, *[c for c in side.columns if c != key]]
    if fits_broadcast(side):
        return rows.join(side, key, "left").select(*columns)
    part: Column = F.pmod(F.xxhash64(spread), F.lit(parts))
    copied = side.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"),
                                                           F.lit(parts - 1).cast("long"))))
    return rows.withColumn("_part", part).join(copied, [key, "_part"], "left").select(*columns)
