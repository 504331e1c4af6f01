"""The feeds of :mod:`jobtide.plans.feeds` as SQL views over the same given tables."""

from __future__ import annotations

from jobtide.functions.ids import DIGITS
from jobtide.plans.feeds import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


def enc(value: str, width: int) -> str:
    return " || ".join(f"substr('{DIGITS}', CAST((({value}) >> {6 * i}) & 63 AS INTEGER) + 1, 1)"
                       for i in range(width - 1, -1, -1))


def dec(text: str) -> str:
    """Number in the leading digits of ``text``, up to eight of them."""
    head = f"regexp_extract({text}, '^[0-9A-Z_a-z~]*')"
    pad = f"lpad({head}, 8, '0')"
    total = " + ".join(f"((instr('{DIGITS}', substr({pad}, {i + 1}, 1)) - 1)::BIGINT << {6 * (7 - i)})"
                       for i in range(8))
    return f"(CASE WHEN length({head}) <= 8 THEN {total} END)"


def ms(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000)"


def new_id(n: str, sysid: str, base_ms: int) -> str:
    return (f"({enc(f'{base_ms} + (({n}) >> 18)', 7)}) || '-{sysid}-' || "
            f"({enc(f'({n}) & 262143', 3)})")


# Fixed value: the form of a journal line.
LINE = r"'^\s*([^|]+)\|([^|]+)\|([^\n\r\x{2028}\x{2029}]*)\z'"

STATE = f"""CASE WHEN lock = '' AND dt > {NOW} THEN 'deferred' WHEN lock = '' THEN 'ready'
 WHEN lock = '__done' THEN 'done' WHEN lock = '__handler' THEN 'handler'
 WHEN dt < {NOW} THEN 'abandoned' ELSE 'running' END"""

CLASS = """CASE exitcode // 100 WHEN 1 THEN 'retry' WHEN 2 THEN 'ok' WHEN 4 THEN 'failed'
 WHEN 5 THEN 'error' ELSE 'other' END"""

FINAL = "(exitcode // 100 IN (2, 4))"

# One entry per view; a view may use those before it.
VIEWS = {
    "jobs": f"""SELECT {enc('epoch_us(ts) // 1000', 7)} || '-q' || (user_id % 4) || '-' ||
 {enc('event_id % 262144', 3)} AS id,
 'c' || (user_id % 10) || '-' || event_type AS type,
 CASE WHEN event_id % 10 = 4 THEN ts + INTERVAL 10 DAY
  WHEN event_id % 10 IN (5, 6) THEN ts + INTERVAL 5 DAY
  WHEN event_id % 10 IN (7, 8) THEN ts + INTERVAL 1000 YEAR ELSE ts END AS dt,
 CASE WHEN event_id % 10 <= 4 THEN '' WHEN event_id % 10 IN (7, 8) THEN '__done'
  ELSE 'd' || (user_id % 4) END AS lock,
 props AS data, event_id, user_id, ts, value, event_type FROM events""",
    "journal": """SELECT CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 97 = 0 THEN data
 ELSE id || '|' || type || '|' || data END AS line FROM jobs
 UNION ALL SELECT id || '|' || type || '|' || data FROM jobs WHERE event_id % 50 = 0""",
    "parsed": f"""SELECT regexp_extract(line, {LINE}, 1) AS id, regexp_extract(line, {LINE}, 2) AS type,
 regexp_extract(line, {LINE}, 3) AS data, {dec(f"regexp_extract(line, {LINE}, 1)")} AS created_ms
 FROM journal WHERE regexp_matches(line, {LINE})""",
    "arrivals": """SELECT line FROM journal UNION ALL
 SELECT line FROM (SELECT replace(id, '-q', '-x') || '|' || type || '|' || data AS line, unnest(range(2 - event_id % 2)) FROM jobs WHERE event_id % 7 = 3)""",
    "arrived": f"""SELECT regexp_extract(line, {LINE}, 1) AS id, regexp_extract(line, {LINE}, 2) AS type,
 regexp_extract(line, {LINE}, 3) AS data, {dec(f"regexp_extract(line, {LINE}, 1)")} AS created_ms
 FROM arrivals WHERE regexp_matches(line, {LINE})""",
    "delivered": "SELECT line FROM journal UNION ALL SELECT line FROM journal WHERE length(line) % 3 = 0 AND line <> ''",
    "delivered_jobs": f"SELECT regexp_extract(line, {LINE}, 2) AS type FROM delivered WHERE regexp_matches(line, {LINE})",
    "runs": f"""SELECT id, type, event_id, attempt, 'd' || (user_id % 4) AS runner,
 CAST(100 * (1 + (event_id + attempt) % 5) + CAST(floor(value) AS BIGINT) % 20 AS INTEGER) AS exitcode,
 ts + attempt * INTERVAL 1 MINUTE AS started, CAST(floor(value * 10) AS BIGINT) AS run_ms,
 ts + attempt * INTERVAL 1 MINUTE + CAST(floor(value * 10) AS BIGINT) * INTERVAL 1 MILLISECOND AS stopped
 FROM (SELECT *, unnest(range(1, 2 + event_id % 3)) AS attempt FROM jobs WHERE event_id % 10 >= 5)""",
    "handlers": """SELECT 'v' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id,
 'c' || (p_partkey % 8) || '-' ||
  (['click', 'error', 'purchase', 'signup', 'view'])[CAST(p_partkey % 5 + 1 AS INTEGER)] AS type,
 p_brand AS eid, lower(string_split(p_type, ' ')[1]) AS lang,
 CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS body,
 CASE WHEN p_partkey % 17 = 0 THEN 0 WHEN p_partkey % 19 <> 0 THEN p_size END AS batch_size FROM part""",
    "latest": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
 (PARTITION BY type ORDER BY id DESC) AS rn FROM handlers) WHERE rn = 1""",
    "start_stop": """SELECT type, id, attempt, started AS ev_at, 1 AS kind, 1 AS d FROM runs
 UNION ALL SELECT type, id, attempt, stopped, 0, -1 FROM runs
 UNION ALL SELECT type, id, attempt, stopped + INTERVAL 1 SECOND, 0, -1 FROM runs
 WHERE event_id % 40 = 5 AND attempt = 1""",
    "clamped": """SELECT *, s - least(0, min(s) OVER w) AS x FROM
 (SELECT *, sum(d) OVER (PARTITION BY type ORDER BY ev_at, kind, id, attempt ROWS UNBOUNDED PRECEDING) AS s
  FROM start_stop)
 WINDOW w AS (PARTITION BY type ORDER BY ev_at, kind, id, attempt ROWS UNBOUNDED PRECEDING)""",
    "call_jobs": """SELECT *, event_id // 20 AS batch,
 row_number() OVER (PARTITION BY event_id // 20 ORDER BY id) - 1 AS pos FROM runs WHERE attempt = 1""",
    "call_outputs": """SELECT batch, string_agg(chunk, chr(10) ORDER BY pos) AS output FROM
 (SELECT batch, pos, concat_ws(chr(10),
   CASE WHEN batch % 9 <> 0 OR pos < 5 THEN
    CASE WHEN event_id % 83 = 0 THEN 'oops' WHEN event_id % 89 = 0 THEN '99999999999999999999 x' ELSE exitcode || ' ' || id END END,
   CASE WHEN event_id % 7 = 0 THEN '# note' END,
   CASE WHEN event_id % 11 = 0 THEN '#J: ' || type || '|{}' END) AS chunk FROM call_jobs)
 WHERE chunk <> '' GROUP BY batch""",
    "output_lines": """SELECT batch, n, line, CASE WHEN starts_with(line, '#') THEN 'comment' ELSE 'response' END AS kind
 FROM (SELECT batch, unnest(string_split(trim(output), chr(10))) AS line,
  generate_subscripts(string_split(trim(output), chr(10)), 1) AS n FROM call_outputs) WHERE line <> ''""",
    "split_lines": """SELECT batch, kind, line, row_number() OVER (PARTITION BY batch, kind ORDER BY n) - 1 AS pos FROM
 (SELECT batch, kind, n, line FROM output_lines
  UNION ALL SELECT batch, 'new_job', n, line FROM output_lines WHERE starts_with(line, '#J: '))""",
    "calls": """SELECT batch, min(started) AS started, max(stopped) AS stopped, batch % 4 <> 0 AS is_batch,
 batch % 13 = 0 AS failed, CASE WHEN batch % 4 = 0 THEN CAST((batch % 5 + 1) * 100 + 4 AS INTEGER) END AS status, CASE WHEN batch % 26 = 0 THEN 'ECONNRESET' END AS error_code
 FROM call_jobs GROUP BY batch""",
    "bodies": "SELECT doc_id, lang || '-' || source AS jobtype, text AS body FROM documents",
    "body_lines": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal,
 row_number() OVER (ORDER BY doc_id, pos) - 1 AS seq FROM
 (SELECT doc_id, jobtype, unnest(string_split(body, chr(10))) AS line,
  generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM bodies)
 WHERE line <> '' AND NOT starts_with(line, '#')""",
    "logs": """SELECT json_object('time', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z',
 'type', CASE WHEN event_id % 61 = 0 THEN 'NOTICE' ELSE
  MAP {'error': 'ERROR', 'signup': 'WARN', 'click': 'INFO', 'view': 'DEBUG', 'purchase': 'TRACE'}[event_type] END,
 'level', MAP {'error': 3, 'signup': 4, 'click': 6, 'view': 7, 'purchase': 8}[event_type],
 'id', 'user' || user_id, 'message', 'job ' || id || ' of type ' || type, 'info', data::JSON) AS line,
 CASE WHEN event_id % 67 = 0 THEN '{"time":' || id END AS bad_line FROM jobs""",
    "leases": f"""SELECT id, max(ts) + INTERVAL 30 MINUTE AS dt, id AS lock, 'queue.sysid' AS type FROM
 (SELECT 'd' || (user_id % 4) AS id, ts FROM events WHERE ts <= {NOW}
  UNION ALL SELECT 'u' || user_id, ts FROM events WHERE ts <= {NOW}) GROUP BY id""",
    "schedules": f"""SELECT p_partkey AS schedule_id, CASE p_partkey % 8
  WHEN 0 THEN p_size || 's' WHEN 1 THEN p_size || 'm' WHEN 2 THEN p_size || ' h'
  WHEN 3 THEN ' ' || p_size || 'd' WHEN 4 THEN p_size || 'w ' WHEN 5 THEN p_size || '000'
  WHEN 6 THEN '.' || p_size || 'm' ELSE 'not read' END AS interval_text,
 CASE p_partkey % 8 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 60000 WHEN 2 THEN p_size * 3600000
  WHEN 3 THEN p_size * 86400000::BIGINT WHEN 4 THEN p_size * 604800000::BIGINT WHEN 5 THEN p_size * 1000
  WHEN 6 THEN CAST(round(CAST('0.' || p_size AS DOUBLE) * 60000) AS BIGINT) END::BIGINT AS interval_ms,
 {ms(NOW)} - CASE WHEN p_partkey % 5 = 0 THEN -p_partkey ELSE p_partkey END * 997 AS start_ms FROM part""",
    "planned": f"""SELECT *, CASE WHEN start_ms > {ms(NOW)} THEN start_ms + interval_ms
 ELSE {ms(NOW)} + (interval_ms - ({ms(NOW)} - start_ms) % interval_ms) END AS next_ms FROM schedules""",
    "board": """SELECT id, count(*) AS attempts, arg_max(exitcode, k) AS exitcode,
 arg_max(runner, k) AS runner FROM (SELECT *, row_number() OVER
 (PARTITION BY id ORDER BY stopped, attempt) AS k FROM runs) GROUP BY id""",
    "held": f"SELECT id, runner AS lock FROM board WHERE NOT {FINAL}",
    "decided": f"""SELECT *, CASE WHEN {FINAL} THEN 'archive'
 WHEN {dec('id')} >= {ms(NOW)} - 21600000 THEN 'retry' ELSE 'abandon' END AS action FROM runs""",
    "last_decided": f"""SELECT id, runner, CASE WHEN {FINAL} THEN 'archive'
 WHEN {dec('id')} >= {ms(NOW)} - 21600000 THEN 'retry' ELSE 'abandon' END AS action FROM board""",
    "lock_events": """WITH h AS (SELECT id, lock, type, ts + INTERVAL 1 MINUTE AS claimed, event_id % 4 AS r,
  event_id % 3 <> 0 AS stops, event_id % 9 = 1 AS again FROM jobs WHERE event_id % 10 IN (5, 6, 9))
 SELECT id, lock, type, CASE WHEN k = 0 THEN 'claim' ELSE 'renew' END AS kind,
  claimed + k * 200 * INTERVAL 1 SECOND AS ev_at FROM (SELECT *, unnest(range(0, r + 1)) AS k FROM h)
 UNION ALL SELECT id, lock, type, 'stop', claimed + (r * 200 + 100) * INTERVAL 1 SECOND FROM h WHERE stops
 UNION ALL SELECT id, lock, type, 'claim', claimed + (r * 200 + 160) * INTERVAL 1 SECOND FROM h WHERE again""",
}

_NEEDS: dict[str, list[str]] = {}
for _name, _sql in VIEWS.items():
    _words = set(_sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    _NEEDS[_name] = [v for v in VIEWS if v in _words and v != _name]


def with_views(sql: str) -> str:
    """``sql`` with the views it uses put before it."""
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    wanted: list[str] = []

    def need(name: str) -> None:
        if name not in wanted:
            for below in _NEEDS[name]:
                need(below)
            wanted.append(name)

    for v in VIEWS:
        if v in words:
            need(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    return f"WITH {ctes}\n{sql}" if ctes else sql
