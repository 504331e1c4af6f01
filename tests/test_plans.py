"""Physical plans: no pairwise joins, no task for a whole table, early cuts and pruning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobtide.operators import journal_ops, transitions as tr
from jobtide.plans import feeds
from jobtide.plans.catalog import QUERIES
from jobtide.session import work_path
from jobtide.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    if "Exchange SinglePartition" in text:
        # Only over per-slice summaries, which are one row per slice.
        assert name in ("id_assign", "running_totals", "chain_jobs")


def test_claim_cuts_to_the_limit_before_the_shuffle(spark):
    text = plan(tr.claim_ranks(feeds.jobs(spark, SF), 5))
    assert text.count("WindowGroupLimit") == 2
    partial = text.index("WindowGroupLimit", text.index("WindowGroupLimit") + 1)
    assert "Exchange hashpartitioning" in text[:partial]


def test_projection_reads_its_columns_only(spark):
    text = QUERIES["waiting_counts"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "props" not in text and "value" not in text


def test_stored_table_prunes_and_pushes_down(spark, now):
    path = work_path(spark, "snap")
    tables.write_snapshot(feeds.jobs(spark, SF), path)
    due = tables.read_snapshot(spark, path, "open").where(F.col("dt") <= F.lit(now)).select("type")
    text = plan(due)
    assert "lock_class" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "LessThanOrEqual(dt" in text.split("PushedFilters: [")[1]
    assert "data" not in text.split("ReadSchema: ")[1]


def test_new_ids_are_looked_for_in_their_days_only(spark):
    path = work_path(spark, "snap")
    jobs = feeds.jobs(spark, SF)
    tables.write_snapshot(jobs, path)
    one = jobs.orderBy("id").limit(3)
    plans = plan(tr.unknown_rows(tables.read_days(spark, path), one, tables.DAY)).split("FileScan")
    text = next(p for p in plans if "created_day" in p.split("ReadSchema")[0])
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "created_day" in filters and "id" in text.split("PushedFilters: [")[1].split("]")[0]
    assert "data" not in text.split("ReadSchema: ")[1].split("\n")[0]


def test_lines_are_numbered_where_they_are(spark):
    bodies = feeds.bodies(spark, SF)
    assert "Exchange" not in plan(journal_ops.jobs_to_lines(bodies, "doc_id", "q0", 0))


def test_limits_change_the_table_in_one_projection(spark):
    jobs = feeds.jobs(spark, SF)
    text = plan(tr.conditional_update(jobs, F.col("lock") == "", {"lock": F.lit("x")}, limit=100))
    assert "Exchange" not in text and text.count("FileScan") == 1
