"""SQL equivalents of the registered queries, over the same given tables."""

from __future__ import annotations

from jobtide.plans.catalog import BASE_MS, CLAIM_LIMIT, QUERIES, SYSID
from jobtide.plans.oracle_views import (CLASS, FINAL, LINE, NOW, STATE, dec, ms, new_id, with_views)

_READY = f"(lock = '' AND dt <= {NOW})"
_STALE = f"(lock <> '' AND dt < {NOW})"


def _table(inner: str, *extra: str) -> str:
    """Comparable columns of a jobs table; ``inner`` gives id, type, lock, dt and the extras."""
    more = "".join(f", {c}" for c in extra)
    return f"SELECT id, type, lock, {STATE} AS state, {ms('dt')} AS dt_ms{more} FROM ({inner})"


def _update(hit: str, lock: str = "lock", dt: str = "dt", source: str = "jobs",
            flag: str = "changed") -> str:
    return _table(f"""SELECT id, type, CASE WHEN hit THEN {lock} ELSE lock END AS lock,
 CASE WHEN hit THEN {dt} ELSE dt END AS dt, hit AS {flag}
 FROM (SELECT *, coalesce({hit}, false) AS hit FROM {source})""", flag)


def _purge(hit: str, source: str = "jobs") -> str:
    return _table(f"SELECT *, {hit} AS removed FROM {source}", "removed")


_RELEASED_LOCK = "CASE WHEN how = 'archive' THEN '__done' ELSE '' END"
_RELEASED_DT = (f"CASE how WHEN 'archive' THEN {NOW} + INTERVAL 1000 YEAR "
                f"WHEN 'retry' THEN {NOW} + INTERVAL 5 MINUTE ELSE {NOW} END")


def _release(releases: str) -> str:
    return _update("lock = owner", _RELEASED_LOCK, _RELEASED_DT,
                   f"(SELECT j.*, r.owner, r.how FROM jobs j LEFT JOIN ({releases}) r ON r.id = j.id)")


_HELD_JOBS = """(SELECT j.*, o.lock AS owner FROM jobs j
 LEFT JOIN (SELECT DISTINCT id, lock FROM held) o ON o.id = j.id)"""

_HANDLER_ROWS = """SELECT id, type, '__handler' AS lock, TIMESTAMP '3000-01-01' AS dt, lang, body,
 coalesce(lang <> '' AND body <> '', false) AS accepted FROM handlers"""

_MERGED = """SELECT id, type, lock, dt, data FROM jobs
 UNION ALL SELECT DISTINCT id, type, '' AS lock, make_timestamp(created_ms * 1000) AS dt, data FROM arrived
 WHERE id NOT IN (SELECT id FROM jobs)"""

_BATCHED = """SELECT j.type, j.id, (j.rn - 1) // coalesce(nullif(l.batch_size, 0), 10) AS batch_no,
 (j.rn - 1) % coalesce(nullif(l.batch_size, 0), 10) AS pos
 FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) AS rn FROM jobs) j
 LEFT JOIN latest l ON l.type = j.type"""

_PARSED = "SELECT id, type, created_ms, data FROM parsed"

_KEPT = f"""SELECT *, CASE WHEN lock = owner THEN 'renew' WHEN {_STALE} THEN 'expire'
  WHEN lock = '__done' AND dt - INTERVAL 1000 YEAR < {NOW} - INTERVAL 7 DAY THEN 'purge_done'
  WHEN lock = '' AND dt < {NOW} - INTERVAL 9 DAY THEN 'purge_unrun' END AS action FROM {_HELD_JOBS}"""

_STATS = f"""SELECT 'runNewJobs' AS name, type, 1::BIGINT AS value FROM decided
 UNION ALL SELECT action || 'Jobs', type, run_ms FROM decided
 UNION ALL SELECT CASE action WHEN 'renew' THEN 'renewLocks' WHEN 'expire' THEN 'expireLocks' ELSE 'expireJobs' END, type, 1
 FROM ({_KEPT}) WHERE action IS NOT NULL
 UNION ALL SELECT 'ingestJournal', type, 1 FROM parsed"""

_LEASES_EXPIRED_EARLIER = f"""(SELECT id, type, CASE WHEN dt < {NOW} - INTERVAL 10 MINUTE THEN '' ELSE lock END AS lock,
 greatest(dt, {NOW} - INTERVAL 10 MINUTE) AS dt FROM leases)"""

_SQL = {
    "journal_scan": "SELECT line FROM journal",
    "body_to_lines": "SELECT doc_id, jobtype, pos::INTEGER AS pos, line FROM body_lines",
    "jobs_to_lines": f"""SELECT doc_id, pos::INTEGER AS pos, {new_id('seq', SYSID, BASE_MS)} || '|' || jobtype || '|' || line AS line
 FROM body_lines""",
    "journal_append": """SELECT line FROM (SELECT line FROM journal
 UNION ALL SELECT string_split(line, '|')[1] FROM journal) WHERE line <> ''""",
    "journal_compact": "SELECT line FROM journal",
    "log_scan": """SELECT line->>'$.time' AS time, line->>'$.type' AS type, (line->>'$.level')::INTEGER AS level,
 line->>'$.id' AS id, line->>'$.message' AS message, (line->>'$.info.k')::BIGINT AS k, bad_line FROM logs WHERE bad_line IS NULL
 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, bad_line FROM logs WHERE bad_line IS NOT NULL""",
    "log_rejects": "SELECT bad_line AS line FROM logs WHERE bad_line IS NOT NULL",
    "log_level_filter": """SELECT line->>'$.time' AS time, line->>'$.type' AS type, line->>'$.id' AS id,
 line->>'$.message' AS message FROM logs WHERE bad_line IS NULL AND line->>'$.type' NOT IN ('DEBUG', 'TRACE')""",
    "jobs_upsert": _table(_MERGED, "data"),
    "journal_parse": _PARSED,
    "journal_rejects": f"SELECT line FROM journal WHERE NOT regexp_matches(line, {LINE})",
    "line_id": "SELECT line, string_split(line, '|')[1] AS line_id FROM journal",
    "id_decode_created": f"SELECT id, {ms('ts')} AS created_ms FROM jobs",
    "id_assign": f"SELECT doc_id, pos::INTEGER AS pos, {new_id('seq', SYSID, BASE_MS)} AS id FROM body_lines",
    "tenant_split": """SELECT id, 'c' || (user_id % 10) AS tenant, event_type AS jobtype, type FROM jobs""",
    "job_state": f"SELECT id, {STATE} AS state FROM jobs",
    "done_at": f"SELECT id, {ms('ts')} AS done_at_ms FROM jobs WHERE lock = '__done'",
    "select_field": "SELECT data AS value FROM jobs UNION ALL SELECT NULL FROM jobs",
    "mask_fields": """SELECT id, eid, lang, body, NULL::VARCHAR AS before, NULL::VARCHAR AS before_each,
 NULL::VARCHAR AS after_each, NULL::VARCHAR AS options FROM handlers""",
    "schedule_next_run": """SELECT schedule_id, interval_ms, next_ms, interval_ms IS NOT NULL AS ok FROM planned""",
    "schedule_due": f"SELECT schedule_id, next_ms FROM planned WHERE next_ms <= {ms(NOW)} + 3600000",
    "schedule_expand": f"""SELECT schedule_id, unnest(range(
 start_ms + greatest(1, (({ms(NOW)} - start_ms) + interval_ms - 1) // interval_ms) * interval_ms,
 {ms(NOW)} + 600000, interval_ms)) AS fire_ms FROM schedules WHERE interval_ms IS NOT NULL""",
    "waiting_counts": f"SELECT type, count(*) AS n FROM jobs WHERE {_READY} GROUP BY type",
    "waiting_types": f"SELECT DISTINCT type FROM jobs WHERE {_READY}",
    "running_types": "SELECT DISTINCT type FROM jobs WHERE lock NOT IN ('', '__done', '__handler')",
    "state_counts": f"SELECT type, {STATE} AS state, count(*) AS n FROM jobs GROUP BY 1, 2",
    "state_rollup": f"""SELECT state, tenant, jobtype, count(*) AS n, grouping(state, tenant, jobtype) AS level FROM
 (SELECT {STATE} AS state, 'c' || (user_id % 10) AS tenant, event_type AS jobtype FROM jobs
  UNION ALL SELECT {STATE}, type, NULL FROM leases)
 GROUP BY GROUPING SETS ((state, tenant, jobtype), (state, tenant), (state))""",
    "uniq": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events",
    "group_by_field": """SELECT lock AS grp, row_number() OVER (PARTITION BY lock ORDER BY id) - 1 AS pos, id FROM jobs""",
    "count_by_field": "SELECT 'c' || (user_id % 10) AS grp, count(*) AS n FROM events GROUP BY 1",
    "stats_sum": f"SELECT name, CAST(sum(value) AS BIGINT) AS total FROM ({_STATS}) GROUP BY name",
    "stats_events": f"SELECT name, type, count(*) AS n FROM ({_STATS}) GROUP BY name, type",
    "ingest_counts": """SELECT 'read' AS kind, NULL AS type, count(*) AS n FROM journal
 UNION ALL SELECT 'kept', type, count(*) FROM parsed GROUP BY type
 UNION ALL SELECT 'rejected', NULL, (SELECT count(*) FROM journal) - (SELECT count(*) FROM parsed)""",
    "stopped_counts": "SELECT type, count(*) AS n FROM runs GROUP BY type",
    "outcome_counts": f"""SELECT type, count(*) FILTER (WHERE k = 'retry') AS retry, count(*) FILTER (WHERE k = 'ok') AS ok,
 count(*) FILTER (WHERE k = 'failed') AS failed, count(*) FILTER (WHERE k = 'error') AS error,
 count(*) FILTER (WHERE k = 'other') AS other, count(*) AS runs,
 count(*) FILTER (WHERE k = 'ok')::DOUBLE / count(*) AS success_rate
 FROM (SELECT type, {CLASS} AS k FROM runs) GROUP BY type""",
    "scoreboard": "SELECT id, exitcode, attempts FROM board",
    "conditional_update": _update(_READY, "'for-c' || (user_id % 10)", "dt + INTERVAL 1 SECOND"),
    "conditional_update_limit": _update(
        f"id IN (SELECT id FROM jobs WHERE {_READY} ORDER BY id LIMIT 100)", "'mine'"),
    "conditional_remove": f"""SELECT id, type, lock, {STATE} AS state, {ms('dt')} AS dt_ms,
 CASE WHEN {_STALE} THEN 'removed' ELSE 'next' END AS part FROM jobs""",
    "add_jobs": f"""SELECT id, type, {ms(NOW)} AS dt_ms, '' AS lock, data, true AS accepted FROM parsed
 UNION ALL SELECT NULL, NULL, {ms(NOW)}, '', line, false FROM journal WHERE NOT regexp_matches(line, {LINE})""",
    "add_jobs_unique": _table(_MERGED, "data"),
    "claim_jobs": _update(f"""id IN (SELECT id FROM jobs WHERE {_READY}
 QUALIFY row_number() OVER (PARTITION BY type ORDER BY id) <= {CLAIM_LIMIT})""", "'d9'",
                          f"{NOW} + INTERVAL 5 MINUTE"),
    "claim_jobs_by_handler": _update(f"""id IN (SELECT id FROM (SELECT j.id, l.batch_size,
 row_number() OVER (PARTITION BY j.type ORDER BY j.id) AS rn FROM (SELECT * FROM jobs WHERE {_READY}) j
 LEFT JOIN latest l ON l.type = j.type) WHERE rn <= coalesce(nullif(batch_size, 0), {CLAIM_LIMIT}))""", "'d9'",
                                     f"{NOW} + INTERVAL 5 MINUTE"),
    "locked_jobs": _table("SELECT * FROM jobs WHERE lock = 'd1' ORDER BY id LIMIT 100"),
    "renew_locks": _update("lock = owner", dt=f"{NOW} + INTERVAL 5 MINUTE", source=_HELD_JOBS),
    "release_jobs": _release(f"""SELECT id, runner AS owner, CASE WHEN {FINAL} THEN 'archive'
 WHEN exitcode // 100 = 1 THEN 'retry' ELSE 'unget' END AS how FROM board"""),
    "expire_locks": _update(_STALE, "''", NOW),
    "purge_jobs": _table("""SELECT id, type, lock, dt, lock = '' AND dt < TIMESTAMP '2024-01-10' AS removed,
 CASE WHEN lock = '' AND dt < TIMESTAMP '2024-01-10' THEN NULL ELSE data END AS data FROM jobs""",
                         "data", "removed"),
    "purge_done": _purge("lock = '__done' AND dt - INTERVAL 1000 YEAR < TIMESTAMP '2024-01-06'"),
    "purge_unrun": _purge("lock = '' AND dt < TIMESTAMP '2024-01-11'"),
    "apply_outcomes": _release("""SELECT id, runner AS owner, action AS how FROM last_decided
 WHERE action <> 'abandon'"""),
    "apply_outcomes_archive": _release("""SELECT id, runner AS owner,
 replace(action, 'abandon', 'archive') AS how FROM last_decided"""),
    "upkeep": _table(f"""SELECT id, type, CASE WHEN action = 'expire' THEN '' ELSE lock END AS lock,
 CASE action WHEN 'renew' THEN {NOW} + INTERVAL 5 MINUTE WHEN 'expire' THEN {NOW} ELSE dt END AS dt,
 CASE WHEN action IN ('purge_done', 'purge_unrun') THEN NULL ELSE data END AS data, action
 FROM ({_KEPT})""",
                     "data", "action"),
    "attach_handlers": """SELECT j.id, j.type, l.id AS handler_id, l.lang, l.body
 FROM jobs j LEFT JOIN latest l ON l.type = j.type""",
    "jobs_without_handler": """SELECT id, type, 500 AS exitcode, 'BAD_HANDLER' AS code FROM jobs
 WHERE type NOT IN (SELECT type FROM latest WHERE lang <> '' AND body <> '')""",
    "held_jobs": "SELECT j.id, j.type, j.lock FROM jobs j SEMI JOIN held o ON o.id = j.id AND o.lock = j.lock",
    "latest_handler": "SELECT type, id, eid, lang, body, batch_size FROM latest",
    "put_handlers": f"""SELECT id, type, {ms('dt')} AS dt_ms, lock, body, accepted FROM ({_HANDLER_ROWS})""",
    "stored_handlers": """SELECT type, id, eid, lang, body, batch_size FROM handlers
 WHERE lang <> '' AND body <> '' QUALIFY row_number() OVER (PARTITION BY type ORDER BY id DESC) = 1""",
    "drop_handlers": _table(f"""SELECT id, type, lock, dt FROM jobs UNION ALL
 SELECT id, type, lock, dt FROM ({_HANDLER_ROWS}) WHERE accepted
 AND type NOT IN (SELECT type FROM latest WHERE body IS NULL)"""),
    "assign_batches": _BATCHED,
    "take_stopped": """SELECT id, attempt::INTEGER AS attempt, row_number() OVER (ORDER BY stopped, id, attempt) <= 200 AS taken
 FROM runs""",
    "running_counts": f"""SELECT type, {ms('ev_at')} AS ev_ms, kind, id, attempt::INTEGER AS attempt, x::BIGINT AS x
 FROM clamped""",
    "running_totals": f"""SELECT {ms('ev_at')} AS ev_ms, kind, id, attempt::INTEGER AS attempt,
 sum(greatest(d, 0)) OVER o::BIGINT AS started_total, sum(d) OVER o::BIGINT AS running_total,
 sum((x > 0)::BIGINT - (before > 0)::BIGINT) OVER o::BIGINT AS active_types
 FROM (SELECT *, coalesce(lag(x) OVER (PARTITION BY type ORDER BY ev_at, kind, id, attempt), 0) AS before FROM clamped)
 WINDOW o AS (ORDER BY ev_at, kind, id, attempt ROWS UNBOUNDED PRECEDING)""",
    "idle_types": """SELECT type, x::BIGINT AS x, x <= 0 AS idle FROM clamped
 QUALIFY row_number() OVER (PARTITION BY type ORDER BY ev_at DESC, kind DESC, id DESC, attempt DESC) = 1""",
    "outcome_class": f"""SELECT id, attempt::INTEGER AS attempt, exitcode, {CLASS} AS class,
 CASE WHEN {FINAL} THEN 'archive' ELSE 'retry' END AS action FROM runs""",
    "retry_or_abandon": "SELECT id, attempt::INTEGER AS attempt, action FROM decided",
    "split_output": "SELECT batch, kind, pos::INTEGER AS pos, line FROM split_lines",
    "align_outcomes": """SELECT c.batch, c.pos::INTEGER AS pos, c.id, c.type,
 CASE WHEN s.line IS NULL OR b.bad <= c.pos THEN 500
  ELSE try_cast(regexp_extract(s.line, '^\\s*\\+?(\\d+)', 1) AS INTEGER) END AS exitcode,
 CASE WHEN s.line IS NULL THEN 'NO_RESPONSE' WHEN b.bad <= c.pos THEN 'INVALID_RESPONSE' END AS code
 FROM call_jobs c LEFT JOIN (SELECT * FROM split_lines WHERE kind = 'response') s
  ON s.batch = c.batch AND s.pos = c.pos
 LEFT JOIN (SELECT batch, min(pos) AS bad FROM split_lines WHERE kind = 'response'
  AND try_cast(regexp_extract(line, '^\\s*\\+?(\\d+)', 1) AS INTEGER) IS NULL GROUP BY batch) b ON b.batch = c.batch""",
    "call_outcomes": f"""SELECT c.batch, c.pos::INTEGER AS pos, c.id, c.type,
 CASE WHEN k.failed THEN 500 WHEN NOT k.is_batch THEN k.status WHEN s.line IS NULL OR b.bad <= c.pos THEN 500
  ELSE try_cast(regexp_extract(s.line, '^\\s*\\+?(\\d+)', 1) AS INTEGER) END AS exitcode,
 CASE WHEN k.failed THEN coalesce(k.error_code, 'BATCH_ERROR') WHEN NOT k.is_batch THEN NULL WHEN s.line IS NULL THEN 'NO_RESPONSE'
  WHEN b.bad <= c.pos THEN 'INVALID_RESPONSE' END AS code,
 ({ms('k.stopped')} - {ms('k.started')})::DOUBLE / CASE WHEN k.is_batch THEN nullif(coalesce(r.answers, 0), 0) ELSE 1 END AS duration
 FROM call_jobs c JOIN calls k ON k.batch = c.batch LEFT JOIN (SELECT * FROM split_lines WHERE kind = 'response') s
  ON s.batch = c.batch AND s.pos = c.pos
 LEFT JOIN (SELECT batch, min(pos) AS bad FROM split_lines WHERE kind = 'response'
  AND try_cast(regexp_extract(line, '^\\s*\\+?(\\d+)', 1) AS INTEGER) IS NULL GROUP BY batch) b ON b.batch = c.batch
 LEFT JOIN (SELECT batch, count(*) FILTER (WHERE kind = 'response') AS answers FROM split_lines GROUP BY batch) r
  ON r.batch = c.batch""",
    "purge_jobs_limit": _table("""SELECT id, type, lock, dt, removed, CASE WHEN removed THEN NULL ELSE data END AS data
 FROM (SELECT *, id IN (SELECT id FROM jobs WHERE lock = '' AND dt < TIMESTAMP '2024-01-12' ORDER BY id LIMIT 300) AS removed FROM jobs)""",
                               "data", "removed"),
    "request_errors": """SELECT c.batch, c.id, c.type, 500 AS exitcode, coalesce(k.error_code, 'BATCH_ERROR') AS code
 FROM call_jobs c JOIN calls k ON k.batch = c.batch WHERE k.failed""",
    "run_durations": f"""SELECT c.batch, c.id, CASE WHEN k.is_batch
  THEN ({ms('k.stopped')} - {ms('k.started')})::DOUBLE / nullif(r.answers, 0)
  ELSE ({ms('k.stopped')} - {ms('k.started')})::DOUBLE END AS duration
 FROM call_jobs c LEFT JOIN calls k ON k.batch = c.batch LEFT JOIN
 (SELECT batch, count(*) FILTER (WHERE kind = 'response') AS answers FROM split_lines GROUP BY batch) r
 ON r.batch = c.batch""",
    "chain_jobs": f"""SELECT batch, pos::INTEGER AS pos, {new_id('seq', SYSID, BASE_MS)} || '|' || substr(line, 5) AS line
 FROM (SELECT *, row_number() OVER (ORDER BY batch, pos) - 1 AS seq FROM split_lines WHERE kind = 'new_job')""",
    "held_job_ids": f"""SELECT id, CASE WHEN started > {NOW} THEN 'waiting' WHEN stopped > {NOW} THEN 'running'
 ELSE 'stopped' END AS held_as FROM runs""",
    "lease_status": f"""SELECT id, CASE WHEN left_ms < 0 THEN 'expired' WHEN left_ms < 1740000 THEN 'degraded' ELSE 'live' END AS status,
 left_ms FROM (SELECT id, {ms('dt')} - {ms(NOW)} AS left_ms FROM leases)""",
    "lease_renew": _update(f"dt >= {NOW}", dt=f"{NOW} + INTERVAL 30 MINUTE", source="leases"),
    "lease_release": _update("starts_with(id, 'd')", "''", NOW, source="leases"),
    "lease_expire": _purge(f"lock = '' AND dt < {NOW}", _LEASES_EXPIRED_EARLIER),
    "jobs_of_dead_owners": f"""SELECT id, type, lock FROM jobs WHERE starts_with(lock, 'd')
 AND lock NOT IN (SELECT lock FROM leases WHERE dt >= {NOW})""",
    "stream_ingest": _PARSED,
    "stream_dedup": f"SELECT DISTINCT * FROM ({_PARSED})",
    "stream_upsert": f"SELECT DISTINCT * FROM ({_PARSED})",
    "stream_lock_expiry": f"""SELECT id, lock, {ms('min(ev_at)')} AS claimed_ms, {ms('max(ev_at)')} + 300000 AS expired_ms,
 count(*) AS events FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY id, lock ORDER BY ev_at, kind) AS session FROM
  (SELECT *, ev_at - lag(ev_at) OVER (PARTITION BY id, lock ORDER BY ev_at, kind) > INTERVAL 300 SECOND AS new FROM lock_events))
 GROUP BY id, lock, session HAVING max(ev_at) FILTER (kind = 'stop') IS DISTINCT FROM max(ev_at)
 AND {ms('max(ev_at)')} + 300000 <= (SELECT {ms('max(ev_at)')} - 600000 FROM lock_events)""",
    "stream_outcome_windows": f"""SELECT window_ms, type, class, count(*) AS n FROM
 (SELECT {ms('stopped')} // 60000 * 60000 AS window_ms, type, {CLASS} AS class FROM runs)
 WHERE window_ms + 60000 <= (SELECT {ms('max(stopped)')} - 600000 FROM runs) GROUP BY ALL""",
    "stream_attach_handlers": """SELECT j.id, j.type, l.id AS handler_id, l.lang, l.body
 FROM jobs j LEFT JOIN latest l ON l.type = j.type WHERE starts_with(j.lock, 'd')""",
    "stream_running_counts": """SELECT type, arg_max(x, k)::BIGINT AS x, sum(kind)::BIGINT AS started_total FROM
 (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ev_at, kind, id, attempt) AS k FROM clamped) GROUP BY type""",
    "stream_stats": """SELECT 'read' AS kind, NULL AS type, count(*) AS n FROM delivered
 UNION ALL SELECT 'kept', type, count(*) FROM delivered_jobs GROUP BY type
 UNION ALL SELECT 'rejected', NULL, (SELECT count(*) FROM delivered) - (SELECT count(*) FROM delivered_jobs)""",
    "stream_retry_ready": f"""SELECT r.id, r.attempt::INTEGER AS attempt, n.attempt::INTEGER AS next_attempt, {ms('r.stopped')} AS released_ms,
 {ms('r.stopped + INTERVAL 5 MINUTE')} AS ready_ms, {ms('n.started')} AS started_ms,
 n.started < r.stopped + INTERVAL 5 MINUTE AS early
 FROM (SELECT * FROM runs WHERE NOT {FINAL}) r LEFT JOIN runs n ON n.id = r.id AND n.attempt > r.attempt AND n.started >= r.stopped
 AND n.started <= r.stopped + INTERVAL 10 MINUTE
 WHERE {ms('r.stopped')} <= (SELECT least(max({ms('started')}), max({ms('stopped')}) FILTER (NOT {FINAL})) - 1800000 - 600000 FROM runs)
 QUALIFY row_number() OVER (PARTITION BY r.id, r.attempt ORDER BY n.started, n.attempt) = 1""",
    "run_payloads": """SELECT id, type, CASE WHEN lang IS NULL OR lang = '' OR coalesce(body, '') = '' THEN 500 ELSE CASE lang WHEN 'economy' THEN 200
  WHEN 'large' THEN CASE WHEN k % 10 = 0 THEN 500 ELSE 200 END
  WHEN 'medium' THEN 100 * (1 + k % 5) WHEN 'small' THEN 200 ELSE 500 END END::INTEGER AS exitcode,
 CASE WHEN lang IS NULL OR lang = '' OR coalesce(body, '') = '' THEN 'BAD_HANDLER' ELSE CASE lang WHEN 'large' THEN CASE WHEN k % 10 = 0 THEN 'ValueError' END
  WHEN 'promo' THEN 'INVALID_RESPONSE' WHEN 'standard' THEN 'BAD_HANDLER' END END AS code,
 CASE WHEN coalesce(body, '') <> '' THEN CASE lang WHEN 'economy' THEN handler_id || ' ' || length(data)
  WHEN 'large' THEN CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END
  WHEN 'small' THEN string_split(body, ' ')[1] END END AS output
 FROM (SELECT j.id, j.type, j.data, (j.data->>'$.k')::BIGINT AS k, l.id AS handler_id, l.lang, l.body
  FROM jobs j LEFT JOIN latest l ON l.type = j.type)""",
}

ORACLES = {name: with_views(_SQL[name]) for name in QUERIES if name in _SQL}
