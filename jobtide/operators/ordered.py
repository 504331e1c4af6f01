"""Numbering and running sums over an order, without one task per group.

A window over a group puts the group in one task, and a job type may hold a third of all rows.
Here the rows are range-partitioned on (group, order), so a big group spans many slices and every
slice is about equally large. The slices are written once (their boundaries come from a sample and
must not move); what one slice passes to the next is a small per-slice summary, and the carry over
a group's slices is a window over at most one row per slice.

The order columns must be unique within a group. Only the columns given are written, so select
what is needed first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobtide.session import cut

_SLOT_BITS = 33  # low bits of monotonically_increasing_id: the row's place in its partition


def _sliced(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with their slice and their place; to be written before it is used twice."""
    keys = [*group, *order]
    return (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("_slot", F.monotonically_increasing_id())
            .withColumn("_slice", F.shiftright("_slot", _SLOT_BITS)))


def _earlier(group: list[str]):
    """The slices of a group before the current one; one row per slice and group."""
    parts = group or [F.lit(0)]
    return W.partitionBy(*parts).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def _with_carry(rows: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    renamed = carry.select(F.col("_slice").alias("_c_slice"),
                           *[F.col(g).alias(f"_c_{g}") for g in group],
                           *[c for c in carry.columns if c not in ("_slice", *group)])
    match = reduce(lambda a, b: a & b,
                   [F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in group],
                   F.col("_slice") == F.col("_c_slice"))
    return rows.join(renamed, match).drop("_c_slice", *[f"_c_{g}" for g in group])


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Adds ``out``: the 1-based number of the row within its group."""
    rows = cut(_sliced(df, group, order), "number")
    per_slice = rows.groupBy("_slice", *group).agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    carry = per_slice.select(
        "_slice", *group, "_first",
        F.coalesce(F.sum("_rows").over(_earlier(group)), F.lit(0)).alias("_before"))
    return (_with_carry(rows, carry, group)
            .withColumn(out, F.col("_slot") - F.col("_first") + F.col("_before") + 1)
            .drop("_slot", "_slice", "_first", "_before"))


def nth_in_order(rows: DataFrame, order: str, n: int) -> tuple[object, int, int] | None:
    """(value, rows before it, rows with it) of the ``n``-th row by one column, NULLs first; None if there are fewer.

    The rows are sorted in slices and counted per slice; the slice that the ``n``-th row is in gives its value.
    What comes to the driver is one count per slice and one row.
    """
    sliced = cut(_sliced(rows.select(order), [], [order]), "nth")
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.min("_slot").alias("first")).orderBy("_slice").collect()
    left = n
    for size in sizes:
        if left <= size["n"]:
            value = sliced.where(F.col("_slot") == size["first"] + left - 1).first()[order]
            at, wanted = F.col(order), F.lit(value).cast(rows.schema[order].dataType)
            before = F.lit(False) if value is None else at.isNull() | (at < wanted)
            counted = sliced.agg(F.count_if(before), F.count_if(at.eqNullSafe(wanted))).first()
            return value, counted[0], counted[1]
        left -= size["n"]
    return None


def running_sums(df: DataFrame, group: list[str], order: list[str],
                 sums: dict[str, Column]) -> DataFrame:
    """Adds one column per entry of ``sums``: its running total, current row included."""
    inside = W.partitionBy("_slice", *group).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    valued = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    local = _sliced(valued, group, order).select(
        *df.columns, "_slice", "_slot", *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums])
    rows = cut(local, "sums")
    last = rows.groupBy("_slice", *group).agg(
        *[F.max_by(f"_s_{n}", "_slot").alias(f"_t_{n}") for n in sums])
    carry = last.select("_slice", *group, *[
        F.coalesce(F.sum(f"_t_{n}").over(_earlier(group)), F.lit(0)).alias(f"_b_{n}")
        for n in sums])
    return _with_carry(rows, carry, group).select(
        *df.columns, *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


# A running count that never goes below zero composes over slices: with S the running sum and M
# its running minimum, the clamped count is S - min(0, M); a slice is summed up by (sum, minimum).


def _slice_sums(df: DataFrame, group: list[str], order: list[str], delta: str) -> DataFrame:
    """Within each slice: ``_s`` the running sum, ``_m`` its running minimum, ``_m_prev`` that of
    the row before."""
    inside = W.partitionBy("_slice", *group).orderBy("_slot")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    return (_sliced(df, group, order)
            .withColumn("_s", F.sum(delta).over(upto))
            .withColumn("_m", F.min("_s").over(upto))
            .withColumn("_m_prev", F.lag("_m").over(inside)))


def _slice_carry(local: DataFrame, group: list[str], delta: str) -> DataFrame:
    """Per slice: what the group's earlier slices add up to (``_off``) and fell to (``_least``)."""
    per_slice = local.groupBy("_slice", *group).agg(
        F.sum(delta).alias("_total"), F.min("_s").alias("_low"),
        F.sum(F.greatest(F.col(delta), F.lit(0))).alias("_gained"))
    off = F.coalesce(F.sum("_total").over(_earlier(group)), F.lit(0))
    least = F.coalesce(F.min(F.col("_off") + F.col("_low")).over(_earlier(group)), F.lit(0))
    return per_slice.withColumn("_off", off).withColumn("_least", least)


def clamped_counts(df: DataFrame, group: list[str], order: list[str], delta: str) -> DataFrame:
    """Adds ``x``, the running sum of ``delta`` kept at zero or above, and ``x_before``."""
    local = cut(_slice_sums(df, group, order, delta), "clamp")
    carry = _slice_carry(local, group, delta).select("_slice", *group, "_off", "_least")
    s, off = F.col("_s"), F.col("_off")
    floor = F.least(F.lit(0), F.col("_least"))
    return (_with_carry(local, carry, group)
            .withColumn("x", off + s - F.least(floor, off + F.col("_m")))
            .withColumn("x_before", off + s - F.col(delta)
                        - F.coalesce(F.least(floor, off + F.col("_m_prev")), floor))
            .drop("_slot", "_slice", "_s", "_m", "_m_prev", "_off", "_least"))


def clamp_summary(df: DataFrame, group: list[str], order: list[str], delta: str) -> DataFrame:
    """Per group: ``total`` (sum of ``delta``), ``low`` (its least running sum, at most 0) and
    ``gained`` (sum of its positive values).

    A count x before the rows becomes ``x + total - least(0, x + low)`` after them. The slices are
    used once here, so nothing is written.
    """
    carry = _slice_carry(_slice_sums(df, group, order, delta), group, delta)
    return carry.groupBy(*group).agg(
        F.sum("_total").alias("total"), F.sum("_gained").alias("gained"),
        F.least(F.lit(0), F.min(F.col("_off") + F.col("_low"))).alias("low"))
