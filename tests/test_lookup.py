"""Joins to a one-row-per-key side beyond broadcast size, with a key that holds most rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobtide.operators.lookup import dealt_lookup, lookup_join


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
        .alias("type"))
    side = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 40)]], "type string, v int")
    return rows, side


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_same_rows_as_a_plain_join(spark, sides, no_broadcast, how):
    rows, side = sides
    got = lookup_join(rows, side, "type", "id", how, rows_per_part=100)
    assert got.columns == ["id", "type", "v"][:3 if how in ("left", "inner") else 2]
    want = rows.join(side, "type", how).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_key_is_dealt_over_tasks(spark, sides, no_broadcast):
    rows, side = sides
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = lookup_join(rows, side, "type", "id", rows_per_part=100)
        per_task = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert per_task < 1500  # the hot key alone has 2667 rows


def test_more_than_a_thousand_hot_keys_are_dealt(spark, no_broadcast):
    rows = spark.range(1500 * 4).select(F.col("id").cast("string").alias("id"), (F.col("id") % 1500).cast("string").alias("type"))
    side = spark.range(1500).select(F.col("id").cast("string").alias("type"), F.col("id").alias("v"))
    got = lookup_join(rows, side, "type", "id", rows_per_part=2)
    want = rows.join(side, "type", "left").select("id", "type", "v")
    assert got.count() == 6000 and got.exceptAll(want).count() == 0


def test_dealt_lookup(spark, sides, no_broadcast):
    rows, side = sides
    got = dealt_lookup(rows, side, "type", "id", 4)
    want = rows.join(side, "type", "left").select("id", "type", "v")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
