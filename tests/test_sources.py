"""Journals, logs, snapshots and payload runs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from jobtide.operators.payloads import PayloadHandler, Registry, run_payloads
from jobtide.plans import feeds
from jobtide.schema import JOB
from jobtide.session import work_path
from jobtide.sources import journal as js, logs, tables


def test_lines_end_at_newlines_only(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1|t|x\r\n2|t|a\rb\n\n3|t|last")
    got = sorted(r["line"] for r in js.journal_scan(spark, str(tmp_path / "a.txt")).collect())
    assert got == ["", "1|t|x\r", "2|t|a\rb", "3|t|last"]


def test_append_counts_kept_lines(spark):
    path = work_path(spark, "append")
    df = spark.createDataFrame([("a",), ("",), ("b",), (None,)], "line string")
    assert js.journal_append(df, path) == 2
    assert js.journal_append(df, path) == 2
    assert sorted(r["line"] for r in js.journal_scan(spark, path).collect()) == ["a", "a", "b", "b"]


def test_compact(spark, tmp_path):
    sources = []
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"line{i}\nx\n")
        sources.append(str(tmp_path / f"{i}.txt"))
    target = str(tmp_path / "target")
    js.journal_compact(spark, sources, target)
    assert sorted(r["line"] for r in js.journal_scan(spark, target).collect()) == sorted(
        ["x"] * 5 + [f"line{i}" for i in range(5)])
    assert len(list((tmp_path / "target").glob("part-*"))) == 1


def test_logs(spark):
    rows = [json.dumps({"time": "t", "type": k, "level": n, "id": "i", "message": "m"})
            for k, n in (("EMERG", 99), ("crit", 1), ("WARN", 4), ("INFO", 6), ("DEBUG", 7), ("odd", 99))]
    df = logs.parse_log_lines(spark.createDataFrame([(r,) for r in [*rows, "no json"]], "line string"))
    assert [r["bad_line"] for r in df.where("bad_line IS NOT NULL").collect()] == ["no json"]
    kept = lambda level: sorted(r["type"] for r in logs.log_level_filter(df, level).collect())
    assert kept("info") == ["EMERG", "INFO", "WARN", "crit", "odd"]
    assert kept("ERROR") == ["EMERG", "crit", "odd"]
    assert [r["line"] for r in logs.log_rejects(df).collect()] == ["no json"]


def test_snapshot_reads_only_its_class(spark, make_jobs, now):
    path = work_path(spark, "snap")
    jobs = make_jobs(("a", "t", 0, ""), ("b", "t", 0, "me"), ("c", "t", 0, "__done"), ("d", "t", 0, "__handler"),
                     ("e", "t", 0, None))
    tables.write_snapshot(jobs, path)
    assert tables.read_snapshot(spark, path).count() == 5
    held = tables.read_snapshot(spark, path, "held")
    assert sorted(r["id"] for r in held.collect()) == ["b", "e"]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "lock_class" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_upsert_leaves_other_files_alone(spark):
    path = work_path(spark, "snap")
    jobs = feeds.jobs(spark, "/root/testdata/sf0.001")
    tables.write_snapshot(jobs, path)
    files = lambda: set(spark.read.parquet(path).inputFiles())
    before = files()
    some = jobs.where("lock = ''").orderBy("id").limit(2).collect()
    rows = spark.createDataFrame([(r.id, r.type, None, "", "again") for r in some]
                                 + [(r.id.replace("-q", "-y"), "t", None, "", "new") for r in some] + [("no time", "t", None, "", "odd")], JOB)
    tables.jobs_upsert(spark, path, rows, "2024-01-16 00:00:00", ["type", "data"])
    assert before < files() and len(files() - before) <= 3
    got = tables.read_snapshot(spark, path)
    assert got.count() == jobs.count() + 3 and got.where("data = 'again'").count() == 0
    seen = files()
    tables.jobs_upsert(spark, path, rows, "2024-01-16 00:00:00", ["type", "data"])
    assert files() == seen


HANDLER_ROWS = "type string, id string, lang string, body string"


def _payload_rows(got):
    by_type = {}
    for r in got:
        by_type.setdefault(r["type"], set()).add((r["exitcode"], r["code"], r["output"]))
    return by_type


def test_payload_functions(spark):
    def _boom(_):
        raise KeyError("x")

    def _refuse():
        raise OSError("no")

    names = ("ok", "boom", "bad", "none", "neg", "setup", "bodyless", "strange")
    jobs = spark.createDataFrame([(f"{k}{i:02}", f"c-{k}", str(i), i // 4) for k in names for i in range(10)],
                                 "id string, type string, data string, batch_no int")
    stored = spark.createDataFrame([(f"c-{k}", "v1", k, "b") for k in names if k not in ("none", "bodyless")] + [("c-bodyless", "v1", "ok", "")],
                                   HANDLER_ROWS)
    got = run_payloads(jobs, stored, Registry({
        "ok": lambda h: PayloadHandler(lambda p: (200 + int(p), p * 2)), "boom": lambda h: PayloadHandler(_boom),
        "bad": lambda h: PayloadHandler(lambda p: None), "neg": lambda h: PayloadHandler(lambda p: -1),
        "setup": lambda h: PayloadHandler(lambda p: 200, before_each=_refuse)})).collect()
    assert len(got) == 80
    assert _payload_rows(got) == {
        "c-ok": {(200 + i, None, str(i) * 2) for i in range(10)}, "c-boom": {(500, "KeyError", None)},
        "c-bad": {(500, "INVALID_RESPONSE", None)}, "c-neg": {(500, "INVALID_RESPONSE", None)},
        "c-setup": {(500, "OSError", None)},
        **{f"c-{k}": {(500, "BAD_HANDLER", None)} for k in ("none", "bodyless", "strange")}}


def test_tenants_have_their_own_versions(spark):
    jobs = spark.createDataFrame([(f"{t}{i}", t, "p", i // 2) for t in ("c1-mail", "c2-mail", "c3-mail") for i in range(300)],
                                 "id string, type string, data string, batch_no int")
    stored = spark.createDataFrame([("c1-mail", "v1", "echo", "old"), ("c1-mail", "v2", "echo", "new"), ("c2-mail", "v1", "echo", "other"),
                                    ("c3-mail", "v8", "echo", "fixed"), ("c3-mail", "v9", "echo", None)], HANDLER_ROWS)
    registry = Registry({"echo": lambda h: PayloadHandler(lambda p: (200, f"{h['id']} {h['body']}"))},
                        {("c2-mail", "v1"): PayloadHandler(lambda p: (201, "own")), ("c3-mail", "v9"): PayloadHandler(lambda p: 202)})
    got = run_payloads(jobs, stored, registry).collect()
    assert len(got) == 900 and _payload_rows(got) == {
        "c1-mail": {(200, None, "v2 new")}, "c2-mail": {(201, None, "own")}, "c3-mail": {(500, "BAD_HANDLER", None)}}


def test_batches_run_whole_across_arrow_frames(spark, tmp_path):
    marks = str(tmp_path)

    def begin():
        import os
        import uuid
        open(os.path.join(marks, uuid.uuid4().hex), "w").close()

    jobs = spark.range(2000).select(
        F.format_string("%04d", "id").alias("id"), F.lit("c-t").alias("type"), F.lit("p").alias("data"), F.floor(F.col("id") / 15).alias("batch_no"))
    stored = spark.createDataFrame([("c-t", "v1", "t", "b")], HANDLER_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        registry = Registry({"t": lambda h: PayloadHandler(lambda p: 200, before_each=begin)})
        got = run_payloads(jobs, stored, registry).where("exitcode = 200").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r["id"] for r in got}) == len(got) == 2000
    assert len(list(tmp_path.iterdir())) == 134
