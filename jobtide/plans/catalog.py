"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.functions import ids, states, text
from jobtide.operators import (concurrency, counts, handlers as h, journal_ops, leases as ls,
                               outcomes, payloads, schedules as sch, transitions as tr)
from jobtide.plans import feeds
from jobtide.schema import HANDLER_FIELDS
from jobtide.session import work_path
from jobtide.sources import journal as js, logs, tables
from jobtide.streaming import ingest as si, locks as sl, outcomes as so
from jobtide.streaming.run import StatsHook, StatsTable, drain_to, drain_to_folder

NOW = feeds.AS_OF
NOW_MS = feeds.AS_OF_MS
SYSID = "q0"
BASE_MS = NOW_MS
CLAIM_LIMIT = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(flagged: DataFrame, *extra: str) -> DataFrame:
    """A jobs table as comparable columns; done rows show their raw dt in milliseconds."""
    return flagged.select(
        "id", "type", "lock", states.job_state(F.col("dt"), F.col("lock"), NOW).alias("state"),
        F.unix_millis("dt").alias("dt_ms"), *extra)


def _written_journal(spark, sf_dir) -> str:
    path = work_path(spark, "journal")
    js.journal_write(feeds.journal(spark, sf_dir), path)
    return path


def _parsed(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", "type", F.unix_millis("dt").alias("created_ms"), "data")


# Sources and sinks


@query
def journal_scan(spark, sf_dir):
    return js.journal_scan(spark, _written_journal(spark, sf_dir))


@query
def body_to_lines(spark, sf_dir):
    return journal_ops.body_to_lines(feeds.bodies(spark, sf_dir)).drop("ordinal")


@query
def jobs_to_lines(spark, sf_dir):
    return journal_ops.jobs_to_lines(feeds.bodies(spark, sf_dir), "doc_id", SYSID, BASE_MS)


@query
def journal_append(spark, sf_dir):
    path = work_path(spark, "append")
    lines = feeds.journal(spark, sf_dir)
    js.journal_append(lines, path)
    js.journal_append(lines.select(text.line_id(F.col("line")).alias("line")), path)
    return js.journal_scan(spark, path)


@query
def journal_compact(spark, sf_dir):
    target = work_path(spark, "compact")
    js.journal_compact(spark, [_written_journal(spark, sf_dir)], target)
    return js.journal_scan(spark, target)


@query
def log_scan(spark, sf_dir):
    path = work_path(spark, "logs")
    js.journal_write(feeds.log_lines(spark, sf_dir), path)
    return logs.log_scan(spark, path).select(
        "time", "type", "level", "id", "message",
        F.get_json_object("info", "$.k").cast("bigint").alias("k"), "bad_line")


@query
def log_rejects(spark, sf_dir):
    return logs.log_rejects(logs.parse_log_lines(feeds.log_lines(spark, sf_dir)))


@query
def log_level_filter(spark, sf_dir):
    kept = logs.log_level_filter(logs.parse_log_lines(feeds.log_lines(spark, sf_dir)))
    return kept.select("time", "type", "id", "message")


def _stored_jobs(spark, sf_dir) -> str:
    path = work_path(spark, "jobs")
    tables.write_snapshot(feeds.jobs(spark, sf_dir), path)
    return path


@query
def jobs_upsert(spark, sf_dir):
    base = _stored_jobs(spark, sf_dir)
    tables.jobs_upsert(spark, base, journal_ops.journal_parse(feeds.arrivals(spark, sf_dir)), NOW, ["type", "data"])
    return _table(tables.read_snapshot(spark, base), "data")


# Projections and filters


@query
def journal_parse(spark, sf_dir):
    return _parsed(journal_ops.journal_parse(feeds.journal(spark, sf_dir)))


@query
def journal_rejects(spark, sf_dir):
    return journal_ops.journal_rejects(feeds.journal(spark, sf_dir))


@query
def line_id(spark, sf_dir):
    return feeds.journal(spark, sf_dir).select("line", text.line_id(F.col("line")).alias("line_id"))


@query
def id_decode_created(spark, sf_dir):
    return feeds.jobs(spark, sf_dir).select("id", ids.created_ms(F.col("id")).alias("created_ms"))


@query
def id_assign(spark, sf_dir):
    keys = journal_ops.body_to_lines(feeds.bodies(spark, sf_dir)).select("doc_id", "pos")
    return journal_ops.id_assign(keys, ["doc_id", "pos"], SYSID, BASE_MS)


@query
def tenant_split(spark, sf_dir):
    t, j = text.tenant(F.col("type")), text.jobtype(F.col("type"))
    return feeds.jobs(spark, sf_dir).select(
        "id", t.alias("tenant"), j.alias("jobtype"), text.tenant_type(t, j).alias("type"))


@query
def job_state(spark, sf_dir):
    return feeds.jobs(spark, sf_dir).select(
        "id", states.job_state(F.col("dt"), F.col("lock"), NOW).alias("state"))


@query
def done_at(spark, sf_dir):
    return feeds.jobs(spark, sf_dir).where("lock = '__done'").select(
        "id", F.unix_millis(states.done_at(F.col("dt"))).alias("done_at_ms"))


@query
def select_field(spark, sf_dir):
    jobs = feeds.jobs(spark, sf_dir)
    return counts.select_field(jobs, "data").unionByName(counts.select_field(jobs, "done_dt"))


@query
def mask_fields(spark, sf_dir):
    masked = counts.mask_fields(feeds.handlers(spark, sf_dir), HANDLER_FIELDS, keep=["id"])
    return masked.withColumnsRenamed({"beforeEach": "before_each", "afterEach": "after_each"})


@query
def schedule_next_run(spark, sf_dir):
    return sch.schedule_next_run(feeds.schedules(spark, sf_dir), NOW_MS).select(
        "schedule_id", "interval_ms", "next_ms", "ok")


@query
def schedule_due(spark, sf_dir):
    planned = sch.schedule_next_run(feeds.schedules(spark, sf_dir), NOW_MS)
    return sch.schedule_due(planned, NOW_MS + 3_600_000).select("schedule_id", "next_ms")


@query
def schedule_expand(spark, sf_dir):
    return sch.schedule_expand(feeds.schedules(spark, sf_dir), NOW_MS, NOW_MS + 600_000)


# Counts


@query
def waiting_counts(spark, sf_dir):
    return counts.waiting_counts(feeds.jobs(spark, sf_dir), NOW)


@query
def waiting_types(spark, sf_dir):
    return counts.waiting_types(feeds.jobs(spark, sf_dir), NOW)


@query
def running_types(spark, sf_dir):
    return counts.running_types(feeds.jobs(spark, sf_dir))


@query
def state_counts(spark, sf_dir):
    return counts.state_counts(feeds.jobs(spark, sf_dir), NOW)


@query
def state_rollup(spark, sf_dir):
    return counts.state_rollup(feeds.jobs(spark, sf_dir).unionByName(feeds.leases(spark, sf_dir)), NOW)


@query
def uniq(spark, sf_dir):
    return counts.uniq(feeds.table(spark, sf_dir, "events"), F.col("user_id"))


@query
def group_by_field(spark, sf_dir):
    return counts.group_by_field(feeds.jobs(spark, sf_dir), F.col("lock"), ["id"])


@query
def count_by_field(spark, sf_dir):
    return counts.count_by_field(feeds.jobs(spark, sf_dir), text.tenant(F.col("type")))


def _stats(spark, sf_dir) -> DataFrame:
    """Lifecycle events (name, type, ids, value) of all eight names, read from what the operators flag."""
    jobs, held = feeds.jobs(spark, sf_dir), feeds.unfinished(spark, sf_dir)
    kept = tr.upkeep(jobs, held, NOW, done_keep_ms=7 * 86_400_000, unrun_keep_ms=9 * 86_400_000)
    return (counts.run_events(outcomes.retry_or_abandon(feeds.runs(spark, sf_dir), NOW))
            .unionByName(counts.upkeep_events(kept))
            .unionByName(counts.ingest_events(journal_ops.journal_parse(feeds.journal(spark, sf_dir)))))


@query
def stats_sum(spark, sf_dir):
    return counts.stats_sum(_stats(spark, sf_dir))


@query
def stats_events(spark, sf_dir):
    return counts.stats_events(_stats(spark, sf_dir))


@query
def ingest_counts(spark, sf_dir):
    return journal_ops.ingest_counts(feeds.journal(spark, sf_dir))


@query
def stopped_counts(spark, sf_dir):
    return counts.stopped_counts(feeds.runs(spark, sf_dir))


@query
def outcome_counts(spark, sf_dir):
    return counts.outcome_counts(feeds.runs(spark, sf_dir))


@query
def scoreboard(spark, sf_dir):
    return outcomes.scoreboard(feeds.runs(spark, sf_dir))


# State transitions


@query
def conditional_update(spark, sf_dir):
    jobs = feeds.jobs(spark, sf_dir)
    return _table(tr.conditional_update(
        jobs, states.is_ready(F.col("dt"), F.col("lock"), NOW),
        {"lock": F.concat(F.lit("for-"), text.tenant(F.col("type"))),
         "dt": states.plus_ms(F.col("dt"), 1000)}), "changed")


@query
def conditional_update_limit(spark, sf_dir):
    jobs = feeds.jobs(spark, sf_dir)
    return _table(tr.conditional_update(
        jobs, states.is_ready(F.col("dt"), F.col("lock"), NOW), {"lock": F.lit("mine")},
        limit=100), "changed")


@query
def conditional_remove(spark, sf_dir):
    jobs = feeds.jobs(spark, sf_dir)
    flagged = tr.conditional_update(jobs, states.is_stale(F.col("dt"), F.col("lock"), NOW), remove=True)
    return (_table(tr.next_table(flagged)).withColumn("part", F.lit("next"))
            .unionByName(_table(tr.affected(flagged)).withColumn("part", F.lit("removed"))))


@query
def add_jobs(spark, sf_dir):
    added = tr.add_jobs(feeds.journal_rows(spark, sf_dir), NOW)
    return added.select("id", "type", F.unix_millis("dt").alias("dt_ms"), "lock", "data", "accepted")


@query
def add_jobs_unique(spark, sf_dir):
    held = tables.read_days(spark, _stored_jobs(spark, sf_dir))
    rows = journal_ops.journal_parse(feeds.arrivals(spark, sf_dir))
    return _table(tr.add_jobs_unique(held, rows, NOW, ["type", "data"], day=tables.DAY), "data")


@query
def claim_jobs(spark, sf_dir):
    return _table(tr.claim_jobs(feeds.jobs(spark, sf_dir), NOW, "d9", CLAIM_LIMIT), "changed")


@query
def claim_jobs_by_handler(spark, sf_dir):
    sizes = h.latest_handler(feeds.handlers(spark, sf_dir).select("id", "type", "batch_size"))
    return _table(tr.claim_jobs(feeds.jobs(spark, sf_dir), NOW, "d9", CLAIM_LIMIT,
                                limits=sizes), "changed")


@query
def locked_jobs(spark, sf_dir):
    return _table(tr.locked_jobs(feeds.jobs(spark, sf_dir), 100, lock="d1"))


@query
def renew_locks(spark, sf_dir):
    return _table(tr.renew_locks(feeds.jobs(spark, sf_dir), feeds.unfinished(spark, sf_dir), NOW),
                  "changed")


@query
def release_jobs(spark, sf_dir):
    board = outcomes.scoreboard(feeds.runs(spark, sf_dir), extra=["runner"])
    kind = states.outcome_class(F.col("exitcode"))
    how = (F.when(kind.isin("ok", "failed"), "archive").when(kind == "retry", "retry")
           .otherwise("unget"))
    wanted = board.select("id", F.col("runner").alias("lock"), how.alias("how"))
    return _table(tr.release_jobs(feeds.jobs(spark, sf_dir), wanted, NOW), "changed")


@query
def expire_locks(spark, sf_dir):
    return _table(tr.expire_locks(feeds.jobs(spark, sf_dir), NOW), "changed")


@query
def purge_jobs(spark, sf_dir):
    flagged = tr.purge_jobs(feeds.jobs(spark, sf_dir), "2024-01-10 00:00:00", lock="")
    return _table(flagged, "data", "removed")


@query
def purge_jobs_limit(spark, sf_dir):
    flagged = tr.purge_jobs(feeds.jobs(spark, sf_dir), lock="", now=NOW, older_ms=4 * 86_400_000, limit=300)
    return _table(flagged, "data", "removed")


@query
def purge_done(spark, sf_dir):
    return _table(tr.purge_done(feeds.jobs(spark, sf_dir), "2024-01-20 00:00:00"), "removed")


@query
def purge_unrun(spark, sf_dir):
    return _table(tr.purge_unrun(feeds.jobs(spark, sf_dir), "2024-02-10 00:00:00"), "removed")


@query
def apply_outcomes(spark, sf_dir):
    return _table(tr.apply_outcomes(feeds.jobs(spark, sf_dir), feeds.runs(spark, sf_dir), NOW), "changed")


@query
def apply_outcomes_archive(spark, sf_dir):
    return _table(tr.apply_outcomes(feeds.jobs(spark, sf_dir), feeds.runs(spark, sf_dir), NOW,
                                    on_abandon="archive"), "changed")


@query
def upkeep(spark, sf_dir):
    return _table(tr.upkeep(feeds.jobs(spark, sf_dir), feeds.unfinished(spark, sf_dir), NOW,
                            done_keep_ms=7 * 86_400_000, unrun_keep_ms=9 * 86_400_000),
                  "data", "action")


# Joins and handlers


@query
def attach_handlers(spark, sf_dir):
    return h.attach_handlers(feeds.jobs(spark, sf_dir), feeds.handlers(spark, sf_dir)).select(
        "id", "type", "handler_id", "lang", "body")


@query
def jobs_without_handler(spark, sf_dir):
    return h.jobs_without_handler(feeds.jobs(spark, sf_dir), feeds.handlers(spark, sf_dir))


@query
def held_jobs(spark, sf_dir):
    return tr.held_jobs(feeds.jobs(spark, sf_dir), feeds.unfinished(spark, sf_dir)).select(
        "id", "type", "lock")


@query
def latest_handler(spark, sf_dir):
    return h.latest_handler(feeds.handlers(spark, sf_dir))


@query
def put_handlers(spark, sf_dir):
    put = h.put_handlers(feeds.handlers(spark, sf_dir))
    return put.select("id", "type", F.unix_millis("dt").alias("dt_ms"), "lock",
                      F.get_json_object("data", "$.body").alias("body"), "accepted")


@query
def stored_handlers(spark, sf_dir):
    put = tr.next_table(h.put_handlers(feeds.handlers(spark, sf_dir)))
    stored = put.unionByName(feeds.jobs(spark, sf_dir))
    return h.latest_handler(h.stored_handlers(stored)).select(
        "type", "id", "eid", "lang", "body", "batch_size")


@query
def drop_handlers(spark, sf_dir):
    versions = feeds.handlers(spark, sf_dir)
    stored = tr.next_table(h.put_handlers(versions)).unionByName(feeds.jobs(spark, sf_dir))
    bodyless = h.latest_handler(versions).where("body IS NULL").select("type")
    return _table(h.drop_handlers(stored, bodyless))


@query
def assign_batches(spark, sf_dir):
    return h.assign_batches(feeds.jobs(spark, sf_dir), feeds.handlers(spark, sf_dir))


# Windows


@query
def take_stopped(spark, sf_dir):
    return outcomes.take_stopped(feeds.runs(spark, sf_dir)).select("id", "attempt", "taken")


@query
def running_counts(spark, sf_dir):
    return concurrency.running_counts(feeds.start_stop(spark, sf_dir)).select(
        "type", F.unix_millis("ev_at").alias("ev_ms"), "kind", "id", "attempt", "x")


@query
def running_totals(spark, sf_dir):
    return concurrency.running_totals(feeds.start_stop(spark, sf_dir)).select(
        F.unix_millis("ev_at").alias("ev_ms"), "kind", "id", "attempt",
        "started_total", "running_total", "active_types")


@query
def idle_types(spark, sf_dir):
    return concurrency.idle_types(feeds.start_stop(spark, sf_dir))


# Outcomes


@query
def outcome_class(spark, sf_dir):
    return outcomes.outcome_class(feeds.runs(spark, sf_dir)).select(
        "id", "attempt", "exitcode", "class", "action")


@query
def retry_or_abandon(spark, sf_dir):
    return outcomes.retry_or_abandon(feeds.runs(spark, sf_dir), NOW).select("id", "attempt", "action")


@query
def split_output(spark, sf_dir):
    return outcomes.split_output(feeds.call_outputs(spark, sf_dir))


@query
def align_outcomes(spark, sf_dir):
    return outcomes.align_outcomes(feeds.call_jobs(spark, sf_dir), feeds.call_outputs(spark, sf_dir))


@query
def call_outcomes(spark, sf_dir):
    return outcomes.call_outcomes(feeds.call_jobs(spark, sf_dir), feeds.calls(spark, sf_dir), feeds.call_outputs(spark, sf_dir))


@query
def request_errors(spark, sf_dir):
    failed = feeds.calls(spark, sf_dir).where("failed")
    return outcomes.request_errors(feeds.call_jobs(spark, sf_dir), failed)


@query
def run_durations(spark, sf_dir):
    return outcomes.run_durations(feeds.call_jobs(spark, sf_dir), feeds.calls(spark, sf_dir),
                                  feeds.call_outputs(spark, sf_dir))


@query
def chain_jobs(spark, sf_dir):
    return outcomes.chain_jobs(feeds.call_outputs(spark, sf_dir), SYSID, BASE_MS)


@query
def held_job_ids(spark, sf_dir):
    runs, at = feeds.runs(spark, sf_dir), states.instant(NOW)
    return outcomes.held_job_ids(
        runs.where((F.col("started") <= at) & (F.col("stopped") > at)),
        runs.where(F.col("started") > at), runs.where(F.col("stopped") <= at))


# Leases


@query
def lease_status(spark, sf_dir):
    return ls.lease_status(feeds.leases(spark, sf_dir), NOW)


@query
def lease_renew(spark, sf_dir):
    leases = feeds.leases(spark, sf_dir)
    mine = leases.where(F.col("dt") >= states.instant(NOW)).select("id")
    return _table(ls.lease_renew(leases, mine, NOW), "changed")


@query
def lease_release(spark, sf_dir):
    leases = feeds.leases(spark, sf_dir)
    daemons = leases.where("id LIKE 'd%'").select("id")
    return _table(ls.lease_release(leases, daemons, NOW), "changed")


@query
def lease_expire(spark, sf_dir):
    earlier = tr.next_table(tr.expire_locks(feeds.leases(spark, sf_dir), NOW_MS - 600_000))
    return _table(ls.lease_expire(earlier, NOW), "removed")


@query
def jobs_of_dead_owners(spark, sf_dir):
    return ls.jobs_of_dead_owners(feeds.jobs(spark, sf_dir), feeds.leases(spark, sf_dir), NOW).select(
        "id", "type", "lock")


# Streams


def _events_stream(spark, sf_dir):
    return feeds.table_stream(spark, sf_dir, "events")


@query
def stream_ingest(spark, sf_dir):
    lines = js.journal_stream(spark, _written_journal(spark, sf_dir))
    return _parsed(drain_to_folder(si.stream_ingest(lines), "ingest"))


def _delivered_twice(spark, sf_dir) -> str:
    """A journal in several files, then about a third of its lines again in others."""
    path = work_path(spark, "journal")
    lines = feeds.journal(spark, sf_dir)
    js.journal_write(lines.repartition(3), path)
    js.journal_append(lines.where(F.length("line") % 3 == 0).repartition(2), path)
    return path


@query
def stream_dedup(spark, sf_dir):
    lines = js.journal_stream(spark, _delivered_twice(spark, sf_dir), max_files=1)
    sink = si.UniqueSink(work_path(spark, "dedup"), ["type", "data"])
    drain_to(si.stream_ingest(lines), sink, "dedup")
    return _parsed(sink.read(spark))


@query
def stream_upsert(spark, sf_dir):
    lines = js.journal_stream(spark, _written_journal(spark, sf_dir), max_files=1)
    sink = si.UpsertSink(work_path(spark, "upsert"), NOW, ["type", "data"])
    drain_to(si.stream_ingest(lines), sink, "upsert")
    return _parsed(sink.read(spark))


@query
def stream_stats(spark, sf_dir):
    lines = js.journal_stream(spark, _delivered_twice(spark, sf_dir), max_files=1)
    emitted = StatsTable(work_path(spark, "stats"))
    hook = StatsHook(emitted)
    drain_to(lines, si.ingest_with_stats(si.UniqueSink(work_path(spark, "ingested"), ["type", "data"]), hook), "stats")
    return counts.stats_totals(emitted.read(spark))


@query
def stream_lock_expiry(spark, sf_dir):
    events = feeds.lock_events_from(_events_stream(spark, sf_dir))
    return drain_to_folder(sl.stream_lock_expiry(events), "stale")


@query
def stream_outcome_windows(spark, sf_dir):
    runs = feeds.runs_from(_events_stream(spark, sf_dir))
    return drain_to_folder(so.stream_outcome_windows(runs), "windows")


@query
def stream_attach_handlers(spark, sf_dir):
    jobs = feeds.jobs_from(_events_stream(spark, sf_dir)).where(
        states.is_running_lock(F.col("lock"))).select("id", "type")
    return drain_to_folder(so.stream_attach_handlers(jobs, feeds.handlers(spark, sf_dir)), "attached")


@query
def stream_running_counts(spark, sf_dir):
    events = feeds.start_stop_from(feeds.runs_from(_events_stream(spark, sf_dir)))
    sink = sl.RunningCounts(work_path(spark, "running"))
    last = drain_to(events, sink, "running").lastProgress
    return sink.read(spark, last["batchId"])


@query
def stream_retry_ready(spark, sf_dir):
    runs = feeds.runs_from(_events_stream(spark, sf_dir))
    releases = runs.where(~states.is_final(F.col("exitcode"))).select(
        "id", "attempt", F.col("stopped").alias("released"))
    return drain_to_folder(so.stream_retry_ready(releases, runs), "ready")


# User functions


def _k_of(payload: str) -> int:
    import json
    return json.loads(payload)["k"]


def _fail_on_tens(payload: str):
    k = _k_of(payload)
    if k % 10 == 0:
        raise ValueError(k)
    return 200, str(k)


# One maker a language of the stored handlers; "standard" is left unknown.
LANGUAGES = {
    "economy": lambda h: payloads.PayloadHandler(body=lambda p: (200, f"{h['id']} {len(p)}")),
    "large": lambda h: payloads.PayloadHandler(body=_fail_on_tens),
    "medium": lambda h: payloads.PayloadHandler(body=lambda p: 100 * (1 + _k_of(p) % 5)),
    "promo": lambda h: payloads.PayloadHandler(body=lambda p: "fine"),
    "small": lambda h: payloads.PayloadHandler(body=lambda p: (200, h["body"].split()[0])),
}


@query
def run_payloads(spark, sf_dir):
    jobs, versions = feeds.jobs(spark, sf_dir), feeds.handlers(spark, sf_dir)
    work = jobs.join(h.assign_batches(jobs, versions), ["id", "type"])
    return payloads.run_payloads(work, versions, payloads.Registry(LANGUAGES)).select(
        "id", "type", "exitcode", "code", "output")
