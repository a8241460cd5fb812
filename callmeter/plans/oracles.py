"""DuckDB SQL for the registered queries: written apart from the Spark code, and in another shape where that helps."""

from __future__ import annotations

LOG = """
ev AS (
  SELECT event_id, user_id, event_type, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 10) AS BIGINT) AS v, epoch_us(ts) // 1000 AS ms FROM events),
st AS (
  SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
    min(ms) OVER (PARTITION BY user_id) AS created_at FROM ev),
shape(event_type, par, i, kind, outcome) AS (VALUES
  ('error', NULL, 0, 'start', NULL), ('error', NULL, 1, 'end', 'failure'), ('error', NULL, 2, 'retry', NULL),
  ('view', NULL, 0, 'start', NULL), ('view', NULL, 1, 'chunk', NULL), ('view', NULL, 2, 'end', 'aborted'),
  ('click', NULL, 0, 'start', NULL), ('click', NULL, 1, 'chunk', NULL), ('click', NULL, 2, 'chunk', NULL), ('click', NULL, 3, 'end', 'success'), ('click', NULL, 4, 'message', NULL),
  ('purchase', NULL, 0, 'context', NULL), ('purchase', NULL, 1, 'message', NULL),
  ('signup', 0, 0, 'header', NULL), ('signup', 0, 1, 'start', NULL),
  ('signup', 1, 0, 'start', NULL), ('signup', 1, 1, 'message', NULL), ('signup', 1, 2, 'end', 'success')),
ex AS (
  SELECT st.*, s.i, s.kind, s.outcome, {copy} AS copy FROM st JOIN shape s ON s.event_type = st.event_type AND (s.par IS NULL OR s.par = st.k % 2) WHERE NOT (s.kind = 'retry' AND st.k % 5 = 0) {less}),
log AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id, i, copy) - 1 AS seq, ms + i AS event_time, kind,
    CASE WHEN kind NOT IN ('header', 'context') THEN n // 8 END AS turn, CASE WHEN kind NOT IN ('header', 'context') THEN n % 8 END AS step,
    CASE WHEN kind IN ('start', 'end') THEN 'a' || event_id END AS attempt_id, outcome,
    CASE WHEN kind IN ('start', 'end', 'header', 'context') THEN 'p' || (user_id % 3) END AS provider,
    CASE WHEN kind IN ('start', 'end', 'header', 'context') THEN {model} END AS model,
    CASE WHEN kind IN ('start', 'end') THEN ms END AS started_at,
    CASE WHEN used THEN v + i END AS input_tokens, CASE WHEN used THEN 3 * k END AS output_tokens,
    CASE WHEN used AND k % 2 = 0 THEN 5 * k END AS cache_read_tokens, CASE WHEN used AND k % 3 = 0 THEN k END AS cache_write_tokens
  FROM (SELECT *, kind = 'chunk' OR (kind = 'message' AND k % 7 <> 0) AS used FROM ex)),
headers AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, min(ms) AS created_at, CASE WHEN user_id % 4 <> 0 THEN '/ws/' || (user_id % 4) END AS cwd, CASE WHEN user_id % 10 = 0 THEN 6 END AS seed_length
  FROM ev GROUP BY user_id)"""
CLEAN = LOG.format(copy="1", less="", model="'m' || (k % 4)")
DIRTY = LOG.format(
    copy="unnest(CASE WHEN s.kind = 'start' AND st.event_id % 51 = 0 THEN [1, 2] ELSE [1] END)", less="AND NOT (s.kind = 'start' AND st.event_id % 50 = 0)",
    model="CASE WHEN kind = 'end' AND event_id % 53 = 0 THEN 'mx' ELSE 'm' || (k % 4) END",
)
_SAME = "{a}.session_id = {b}.session_id AND {a}.created_at = {b}.created_at"
_STEP = _SAME + " AND {a}.turn = {b}.turn AND {a}.step = {b}.step"
FOLD = f"""
routed AS (
  SELECT l.*, h.cwd AS workspace, h.seed_length,
    coalesce(last_value(CASE WHEN kind IN ('header', 'context') THEN l.provider END IGNORE NULLS) OVER w, 'unknown') AS route_provider,
    coalesce(last_value(CASE WHEN kind IN ('header', 'context') THEN l.model END IGNORE NULLS) OVER w, 'unknown') AS route_model
  FROM log l JOIN headers h ON {_SAME.format(a='l', b='h')} WINDOW w AS (PARTITION BY l.session_id, l.created_at ORDER BY l.seq)),
live AS (SELECT * FROM routed WHERE seq >= coalesce(seed_length, 0)),
opened AS (SELECT session_id, created_at, attempt_id, min(seq) AS s0, arg_min(started_at, seq) AS t0 FROM live WHERE kind = 'start' GROUP BY ALL),
ends AS (SELECT l.*, o.t0, o.s0 FROM live l JOIN opened o ON {_SAME.format(a='l', b='o')} AND l.attempt_id = o.attempt_id WHERE l.kind = 'end' AND o.s0 < l.seq),
marks AS (
  SELECT session_id, created_at, turn, step, seq, attempt_id AS opens FROM live WHERE kind = 'start'
  UNION ALL SELECT session_id, created_at, turn, step, seq, NULL FROM ends),
wins AS (SELECT session_id, created_at, turn, step, seq, attempt_id FROM ends WHERE outcome = 'success'),
said AS (
  SELECT e.*, m.opens AS active, w.attempt_id AS earlier FROM live e
  ASOF LEFT JOIN marks m ON {_STEP.format(a='e', b='m')} AND e.seq > m.seq
  ASOF LEFT JOIN wins w ON {_STEP.format(a='e', b='w')} AND e.seq > w.seq
  WHERE e.kind IN ('chunk', 'message')),
legacy AS (
  SELECT session_id, created_at, turn, step, min(seq) AS seq, 'legacy:' || turn || ':' || step AS attempt_id FROM said WHERE kind = 'message' AND active IS NULL AND earlier IS NULL GROUP BY session_id, created_at, turn, step),
wins2 AS (SELECT * FROM wins UNION ALL SELECT session_id, created_at, turn, step, seq, attempt_id FROM legacy),
spoke AS (
  SELECT s.*, w.attempt_id AS successful, l.attempt_id AS legacy_id FROM said s
  ASOF LEFT JOIN wins2 w ON {_STEP.format(a='s', b='w')} AND s.seq > w.seq
  LEFT JOIN legacy l ON {_STEP.format(a='s', b='l')} AND s.seq = l.seq),
first AS (
  SELECT session_id, created_at, workspace, attempt_id, arg_min(turn, seq) AS turn, arg_min(step, seq) AS step, arg_min(provider, seq) AS provider, arg_min(model, seq) AS model, arg_min(started_at, seq) AS started_at, NULL AS made
  FROM live WHERE kind = 'start' GROUP BY session_id, created_at, workspace, attempt_id
  UNION ALL SELECT session_id, created_at, workspace, legacy_id, turn, step, route_provider, route_model, event_time, 'success' FROM spoke WHERE legacy_id IS NOT NULL),
ended AS (SELECT session_id, created_at, attempt_id, arg_max(outcome, seq) AS outcome FROM ends GROUP BY ALL),
prov AS (
  SELECT session_id, created_at, active AS attempt_id, arg_max({{'i': input_tokens, 'o': output_tokens, 'r': coalesce(cache_read_tokens, 0), 'w': coalesce(cache_write_tokens, 0)}}, seq) AS u
  FROM spoke WHERE kind = 'chunk' AND active IS NOT NULL AND input_tokens IS NOT NULL GROUP BY session_id, created_at, active),
fin AS (
  SELECT session_id, created_at, coalesce(legacy_id, successful) AS attempt_id, arg_max({{'i': input_tokens, 'o': output_tokens, 'r': coalesce(cache_read_tokens, 0), 'w': coalesce(cache_write_tokens, 0)}}, seq) AS u
  FROM spoke WHERE kind = 'message' AND input_tokens IS NOT NULL AND coalesce(legacy_id, successful) IS NOT NULL GROUP BY ALL),
ops AS (
  SELECT session_id, created_at, turn, step, seq, attempt_id, 1 AS d FROM ends WHERE outcome IN ('failure', 'aborted')
  UNION ALL SELECT session_id, created_at, turn, step, seq, NULL, -1 FROM live WHERE kind = 'retry'),
run AS (SELECT *, sum(d) OVER w AS r FROM ops WINDOW w AS (PARTITION BY session_id, created_at, turn, step ORDER BY seq)),
deep AS (SELECT *, r - least(0, min(r) OVER w) AS depth FROM run WINDOW w AS (PARTITION BY session_id, created_at, turn, step ORDER BY seq)),
lev AS (SELECT *, CASE WHEN d = 1 THEN depth ELSE coalesce(lag(depth) OVER (PARTITION BY session_id, created_at, turn, step ORDER BY seq), 0) END AS level FROM deep),
ret AS (
  SELECT session_id, created_at, attempt_id FROM (
    SELECT *, lead(d) OVER (PARTITION BY session_id, created_at, turn, step, level ORDER BY seq) AS nxt FROM lev WHERE level > 0) WHERE d = 1 AND nxt = -1),
calls AS (
  SELECT f.session_id, f.created_at, f.workspace, strftime(epoch_ms(f.started_at), '%Y-%m-%d') AS day, f.attempt_id, f.turn, f.step, f.provider, f.model, f.started_at,
    coalesce(e.outcome, f.made) AS outcome, r.attempt_id IS NOT NULL AS retry_scheduled,
    p.u.i AS p_input, p.u.o AS p_output, p.u.r AS p_cache_read, p.u.w AS p_cache_write, n.u.i AS f_input, n.u.o AS f_output, n.u.r AS f_cache_read, n.u.w AS f_cache_write
  FROM first f LEFT JOIN ended e USING (session_id, created_at, attempt_id) LEFT JOIN prov p USING (session_id, created_at, attempt_id)
  LEFT JOIN fin n USING (session_id, created_at, attempt_id) LEFT JOIN ret r USING (session_id, created_at, attempt_id)),
measured AS (
  SELECT *, CASE WHEN f_input IS NOT NULL THEN f_input ELSE p_input END AS input_tokens, CASE WHEN f_input IS NOT NULL THEN f_output ELSE p_output END AS output_tokens,
    CASE WHEN f_input IS NOT NULL THEN f_cache_read ELSE p_cache_read END AS cache_read_tokens, CASE WHEN f_input IS NOT NULL THEN f_cache_write ELSE p_cache_write END AS cache_write_tokens FROM calls)"""

_FLAGS = """count(*)::BIGINT AS requests, count(*) FILTER (outcome = 'success')::BIGINT AS successful_requests, count(*) FILTER (outcome IN ('failure', 'aborted'))::BIGINT AS failed_requests,
  count(*) FILTER (retry_scheduled)::BIGINT AS retry_requests, count(input_tokens)::BIGINT AS metered_requests, (count(*) - count(input_tokens))::BIGINT AS unmetered_requests"""
_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"))
ALL_MEASURES = f"{_SUMS}, {_FLAGS}"
ZONE, FROM, THROUGH = "Asia/Shanghai", "2024-01-02", "2024-01-31"
LOCAL = "strftime((epoch_ms({0}) AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d')"
SNAP = f"""
selected AS (SELECT * FROM (SELECT *, {LOCAL.format('started_at')} AS local_day FROM measured) WHERE local_day BETWEEN '{FROM}' AND '{THROUGH}'),
spine AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(DATE '{FROM}', DATE '{THROUGH}', INTERVAL 1 DAY)) AS d)),
models AS (SELECT workspace, provider, model, {ALL_MEASURES} FROM selected GROUP BY ALL),
daily AS (SELECT s.day, {', '.join(f'coalesce(x.{c}, 0) AS {c}' for c in ('input_tokens', 'output_tokens', 'cache_read_tokens', 'cache_write_tokens', 'requests', 'successful_requests', 'failed_requests', 'retry_requests', 'metered_requests', 'unmetered_requests'))}
  FROM spine s LEFT JOIN (SELECT local_day AS day, {ALL_MEASURES} FROM selected GROUP BY local_day) x USING (day)),
feed AS (
  SELECT started_at AS "at", workspace, provider, model, coalesce(outcome, 'started') AS outcome, retry_scheduled AS retried, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, session_id, created_at, attempt_id, local_day FROM selected),
pev AS (
  SELECT "at", provider, model, outcome, retried, coalesce(input_tokens, 0) AS input, coalesce(output_tokens, 0) AS output, coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) AS cached,
    coalesce(cache_read_tokens, 0) AS cache_hit, input_tokens IS NOT NULL AS metered, CASE WHEN "at" > 0 THEN local_day END AS local_day FROM feed),
pmo AS (
  SELECT provider, model, sum(requests)::BIGINT AS requests, sum(input_tokens)::BIGINT AS input, sum(output_tokens)::BIGINT AS output, sum(cache_read_tokens + cache_write_tokens)::BIGINT AS cached, sum(cache_read_tokens)::BIGINT AS cache_hit,
    sum(unmetered_requests)::BIGINT AS unmetered, sum(failed_requests)::BIGINT AS failed, sum(retry_requests)::BIGINT AS retried FROM models GROUP BY provider, model),
pda AS (
  SELECT day, requests, input_tokens AS input, output_tokens AS output, cache_read_tokens + cache_write_tokens AS cached, cache_read_tokens AS cache_hit, unmetered_requests AS unmetered, failed_requests AS failed, retry_requests AS retried FROM daily),
week AS (SELECT * FROM pev WHERE local_day BETWEEN strftime((SELECT max(local_day) FROM pev)::DATE - 6, '%Y-%m-%d') AND (SELECT max(local_day) FROM pev)),
wspine AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series((SELECT max(local_day) FROM pev)::DATE - 6, (SELECT max(local_day) FROM pev)::DATE, INTERVAL 1 DAY)) AS d))"""
FIGURES = """count(*)::BIGINT AS requests, coalesce(sum(input), 0)::BIGINT AS input, coalesce(sum(output), 0)::BIGINT AS output, coalesce(sum(cached), 0)::BIGINT AS cached, coalesce(sum(cache_hit), 0)::BIGINT AS cache_hit,
  count(*) FILTER (NOT metered)::BIGINT AS unmetered, count(*) FILTER (outcome IN ('failure', 'aborted'))::BIGINT AS failed, count(*) FILTER (retried)::BIGINT AS retried"""
_NAMES = ("requests", "input", "output", "cached", "cache_hit", "unmetered", "failed", "retried")
BUCKETS = f"SELECT s.day, {', '.join(f'coalesce(x.{c}, 0) AS {c}' for c in _NAMES)} FROM wspine s LEFT JOIN (SELECT local_day AS day, {FIGURES} FROM week WHERE provider = 'p1' GROUP BY local_day) x USING (day)"


def on_log(select: str, dirty: bool = False) -> str:
    return f"WITH {DIRTY if dirty else CLEAN}\n{select}"


def on_calls(select: str) -> str:
    return f"WITH {CLEAN},{FOLD}\n{select}"


def on_snapshot(select: str) -> str:
    return f"WITH {CLEAN},{FOLD},{SNAP}\n{select}"


_KEY = "session_id, created_at, attempt_id"
_USED = "p_input, p_output, p_cache_read, p_cache_write, f_input, f_output, f_cache_read, f_cache_write"
_INTEGRITY = """, att AS (
  SELECT *, lag(kind) OVER w AS was, lag(turn) OVER w AS was_turn, lag(step) OVER w AS was_step, lag(provider) OVER w AS was_provider, lag(model) OVER w AS was_model, lead(kind) OVER w AS nxt
  FROM log WHERE kind IN ('start', 'end') WINDOW w AS (PARTITION BY session_id, created_at, attempt_id ORDER BY seq))
SELECT session_id, seq, attempt_id, turn, step FROM att WHERE """
_BAD = """SELECT session_id, CASE WHEN started_at % 11 = 0 THEN -created_at ELSE created_at END AS created_at, CASE WHEN started_at % 7 = 0 THEN '' ELSE day END AS day, attempt_id, CASE WHEN started_at % 5 = 0 THEN -1 - turn ELSE turn END AS turn,
  step, provider, model, started_at, CASE WHEN started_at % 13 = 0 THEN 'bad' ELSE outcome END AS outcome, f_input FROM calls"""
_COMPACT = """CASE WHEN {x} < 1000 THEN CAST({x} AS VARCHAR) ELSE (SELECT rtrim(rtrim((r // 100) || '.' || lpad(CAST(r % 100 AS VARCHAR), 2, '0'), '0'), '.') || u
  FROM (SELECT (CAST({x} AS HUGEINT) * 100 + m // 2) // m AS r, u, below FROM (VALUES (1000, 999995, 'K'), (1000000, 999995000, 'M'), (1000000000, 999995000000, 'B'), (1000000000000, 9223372036854775807, 'T')) t(m, below, u))
  WHERE {x} < below ORDER BY below LIMIT 1) END"""
_CURSOR = f""", seen AS (SELECT session_id, created_at, workspace, max(seq) AS observed_seq FROM live GROUP BY ALL),
lasts AS (SELECT session_id, created_at, turn, step, arg_max(coalesce(opens, ''), seq) AS opens FROM marks GROUP BY ALL),
won AS (SELECT session_id, created_at, turn, step, arg_max(attempt_id, seq) AS won FROM wins2 GROUP BY ALL),
cursor AS (SELECT s.*, coalesce((SELECT string_agg(turn || ':' || step || '=' || opens, ',' ORDER BY turn || ':' || step) FROM lasts l WHERE {_SAME.format(a='l', b='s')} AND opens <> ''), '') AS active_attempts,
  coalesce((SELECT string_agg(turn || ':' || step || '=' || won, ',' ORDER BY turn || ':' || step) FROM won l WHERE {_SAME.format(a='l', b='s')}), '') AS successful_attempts FROM seen s)"""
_SPOILED = """
hit AS (SELECT *, CASE WHEN (seq * 31 + event_time) % 7 = 0 THEN (seq * 31 + event_time) & 7 ELSE -1 END AS n FROM whole),
judged AS (SELECT *, concat_ws(', ', CASE WHEN kind IN ('start', 'end', 'retry', 'chunk', 'message') AND turn IS NULL THEN 'without turn' END, CASE WHEN step < 0 THEN 'negative step' END,
    CASE WHEN kind IN ('start', 'end') AND attempt_id IS NULL THEN 'without attempt_id' END, CASE WHEN kind IN ('start', 'header', 'context') AND provider IS NULL THEN 'without provider' END,
    CASE WHEN kind = 'start' AND started_at < 0 THEN 'negative started_at' END, CASE WHEN kind = 'end' AND outcome = 'lost' THEN 'unknown outcome' END,
    CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NULL THEN 'without output_tokens' END, CASE WHEN output_tokens < 0 THEN 'negative output_tokens' END) AS reason
  FROM (SELECT * REPLACE (CASE WHEN n <> 0 THEN turn END AS turn, CASE WHEN n = 1 THEN -1 - step ELSE step END AS step, CASE WHEN n <> 2 THEN attempt_id END AS attempt_id, CASE WHEN n <> 3 THEN provider END AS provider,
    CASE WHEN n = 4 THEN -1 - started_at ELSE started_at END AS started_at, CASE WHEN n = 5 THEN -1 - output_tokens WHEN n <> 6 THEN output_tokens END AS output_tokens, CASE WHEN n = 7 THEN CASE WHEN kind IS NOT NULL THEN 'lost' END ELSE outcome END AS outcome) FROM hit)),
log AS (SELECT * FROM judged WHERE reason = '')"""

SQL: dict[str, str] = {
    "read_log": on_log("SELECT * FROM log"),
    "merge_live_cold": on_log("SELECT session_id, seq, kind, CASE WHEN CAST(session_id AS BIGINT) % 5 = 0 THEN event_time + 1 ELSE event_time END AS event_time FROM log"),
    "drop_fork_prefix": on_log("SELECT l.session_id, l.seq, l.kind FROM log l JOIN headers h USING (session_id, created_at) WHERE h.seed_length IS NULL OR l.seq >= h.seed_length"),
    "classify_event": on_log("""SELECT session_id, seq, kind, CASE kind WHEN 'header' THEN 'route' WHEN 'context' THEN 'route' WHEN 'start' THEN 'open' WHEN 'end' THEN 'close' WHEN 'retry' THEN 'mark_retry'
  WHEN 'chunk' THEN CASE WHEN input_tokens IS NOT NULL THEN 'provisional_usage' END WHEN 'message' THEN 'message' END AS action FROM log"""),
    "carry_route": on_calls("SELECT session_id, seq, route_provider, route_model FROM routed"),
    "call_key": on_calls("""SELECT '["' || session_id || '",' || created_at || ',"' || attempt_id || '"]' AS call_key FROM calls"""),
    "step_key": on_calls("SELECT session_id, attempt_id, turn || ':' || step AS step_key FROM calls"),
    "same_lifecycle": on_log("SELECT session_id, (CAST(session_id AS BIGINT) % 3 <> 0 AND CAST(session_id AS BIGINT) % 7 <> 0) OR (CAST(session_id AS BIGINT) % 3 <> 0 AND cwd IS NULL) AS same FROM headers"),
    "utc_day": on_log("SELECT session_id, seq, strftime(epoch_ms(event_time), '%Y-%m-%d') AS day FROM log"),
    "zone_day": on_log("""SELECT session_id, seq, strftime((epoch_ms(event_time) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS new_york, strftime((epoch_ms(event_time) AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Kiritimati', '%Y-%m-%d') AS kiritimati FROM log"""),
    "shift_day": on_log("SELECT session_id, seq, strftime(epoch_ms(event_time)::DATE - 29, '%Y-%m-%d') AS before, strftime(epoch_ms(event_time)::DATE + 365, '%Y-%m-%d') AS after FROM log"),
    "open_attempts": on_calls("SELECT session_id, created_at, attempt_id, turn, step, provider, model, started_at FROM first WHERE made IS NULL"),
    "close_attempts": on_calls(f"SELECT {_KEY}, outcome FROM ended"),
    "active_attempt_at": on_calls("SELECT session_id, seq, active FROM said"),
    "successful_attempt_at": on_calls("SELECT session_id, seq, successful FROM spoke"),
    "provisional_usage": on_calls(f"SELECT {_KEY}, u.i AS p_input, u.o AS p_output, u.r AS p_cache_read, u.w AS p_cache_write FROM prov"),
    "final_usage": on_calls(f"SELECT {_KEY}, u.i AS f_input, u.o AS f_output, u.r AS f_cache_read, u.w AS f_cache_write FROM fin"),
    "legacy_attempts": on_calls("SELECT session_id, created_at, attempt_id, turn, step, provider, model, started_at, outcome FROM calls WHERE attempt_id LIKE 'legacy:%'"),
    "mark_retries": on_calls(f"SELECT {_KEY} FROM ret"),
    "usage_defaults": on_log("SELECT session_id, seq, input_tokens, output_tokens, coalesce(cache_read_tokens, 0) AS cache_read_tokens, coalesce(cache_write_tokens, 0) AS cache_write_tokens FROM log WHERE input_tokens IS NOT NULL"),
    "effective_usage": on_calls(f"SELECT {_KEY}, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens FROM measured"),
    "build_calls": on_calls("SELECT * FROM calls"),
    "scan_calls": on_calls(f"SELECT {_KEY}, outcome, {_USED} FROM calls"),
    "stream_calls": on_calls("SELECT * FROM calls"),
    "replay_from_cursor": on_calls("SELECT * FROM calls"),
    "stream_from_batch": on_calls("SELECT * FROM calls"),
    "isolation": f"""WITH {CLEAN.replace("log AS (", "whole AS (")},{_SPOILED},{FOLD}
SELECT 'call' AS part, session_id, attempt_id, outcome, retry_scheduled, p_input, p_output, f_input, f_output FROM calls
UNION ALL SELECT 'bad: ' || reason, session_id, NULL, NULL, NULL, count(*), NULL, NULL, NULL FROM judged WHERE reason <> '' GROUP BY reason, session_id""",
    "session_cursor": on_calls(f"{_CURSOR} SELECT * FROM cursor"),
    "stream_cursor": on_calls(f"{_CURSOR} SELECT c.*, r.route_provider, r.route_model FROM cursor c JOIN live r USING (session_id, created_at) WHERE r.seq = c.observed_seq"),
    "drop_disposed": on_calls("SELECT session_id, created_at, workspace, max(seq) AS observed_seq FROM live WHERE NOT (CAST(session_id AS BIGINT) % 3 = 0 AND CAST(session_id AS BIGINT) % 2 = 1) GROUP BY ALL"),
    "validate_calls": on_calls(f"""SELECT session_id, attempt_id, ok_numbers, ok_texts, ok_day, ok_outcome, ok_usage, ok_numbers AND ok_texts AND ok_day AND ok_outcome AND ok_usage AS valid FROM (SELECT *, created_at >= 0 AND turn >= 0 AND step >= 0 AND started_at >= 0 AS ok_numbers, true AS ok_texts,
  regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS ok_day, outcome IS NULL OR outcome IN ('success', 'failure', 'aborted') AS ok_outcome, started_at % 3 <> 0 OR f_input IS NULL AS ok_usage FROM ({_BAD}))"""),
    "validate_cursor": on_calls(f"""{_CURSOR} SELECT session_id, ok_seq, ok_active, ok_successful, ok_seq AND ok_active AND ok_successful AS valid FROM (
  SELECT session_id, id % 4 <> 0 AS ok_seq, id % 3 <> 0 AS ok_active, id % 5 <> 0 OR successful_attempts = '' AS ok_successful FROM (SELECT *, CAST(session_id AS BIGINT) AS id FROM cursor))"""),
    "attempt_measures": on_calls(f"""SELECT {_KEY}, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, coalesce(cache_read_tokens, 0) AS cache_read_tokens, coalesce(cache_write_tokens, 0) AS cache_write_tokens, 1::BIGINT AS requests,
  CASE WHEN outcome = 'success' THEN 1 ELSE 0 END::BIGINT AS successful_requests, CASE WHEN outcome IN ('failure', 'aborted') THEN 1 ELSE 0 END::BIGINT AS failed_requests, retry_scheduled::INT::BIGINT AS retry_requests,
  (input_tokens IS NOT NULL)::INT::BIGINT AS metered_requests, (input_tokens IS NULL)::INT::BIGINT AS unmetered_requests FROM measured"""),
    "day_range_filter": on_snapshot(f"SELECT {_KEY}, local_day FROM selected WHERE local_day >= '2024-01-25'"),
    "workspace_filter": on_calls(f"SELECT {_KEY}, workspace FROM calls WHERE workspace = '/ws/2'"),
    "model_rollup": on_calls(f"SELECT workspace, provider, model, {ALL_MEASURES} FROM measured GROUP BY ALL"),
    "order_models": on_snapshot("SELECT row_number() OVER (ORDER BY coalesce(workspace, ''), provider, model) AS place, workspace, provider, model, requests FROM models"),
    "calendar_spine": on_snapshot("SELECT day FROM spine"),
    "daily_rollup": on_snapshot("SELECT * FROM daily"),
    "write_marts": on_snapshot("SELECT * FROM daily"),
    "upsert_calls": on_calls("SELECT * FROM calls"),
    "event_feed": on_snapshot("SELECT * EXCLUDE (local_day) FROM feed"),
    "snapshot": on_snapshot("""SELECT 'models' AS part, coalesce(workspace, '-') || '|' || provider || '|' || model AS key, requests, input_tokens, output_tokens FROM models UNION ALL SELECT 'daily', day, requests, input_tokens, output_tokens FROM daily
UNION ALL SELECT 'events', NULL, count(*), sum(input_tokens)::BIGINT, sum(output_tokens)::BIGINT FROM feed"""),
    "panel_events": on_snapshot("SELECT * EXCLUDE (local_day) FROM pev"),
    "panel_models": on_snapshot("SELECT * FROM pmo"),
    "panel_daily": on_snapshot("SELECT * FROM pda"),
    "panel_local_day": on_snapshot('SELECT "at", local_day FROM pev'),
    "filter_provider_model": on_snapshot('SELECT "at", provider, model, outcome FROM pev WHERE provider = \'p1\' AND model = \'m2\''),
    "filter_period": on_snapshot('SELECT "at", provider, model, local_day FROM week'),
    "infer_end_day": on_snapshot("SELECT (SELECT max(local_day) FROM pev) AS from_events, (SELECT max(day) FROM pda WHERE requests > 0) AS from_daily"),
    "model_breakdown": on_snapshot(f"SELECT '' AS provider, model, {FIGURES} FROM pev GROUP BY model UNION ALL SELECT provider, model, {FIGURES} FROM pev GROUP BY provider, model"),
    "total_tokens": on_snapshot("SELECT provider, model, input + output + cached AS total FROM pmo"),
    "rank_models": on_snapshot("SELECT row_number() OVER (ORDER BY input + output + cached DESC, provider, model) AS place, provider, model, input + output + cached AS total FROM pmo"),
    "provider_options": on_snapshot("SELECT DISTINCT provider FROM pev"),
    "model_options": on_snapshot("SELECT DISTINCT model FROM pev WHERE provider = 'p1'"),
    "panel_totals": on_snapshot(f"SELECT {FIGURES} FROM week"),
    "buckets_from_events": on_snapshot(BUCKETS),
    "buckets_from_daily": on_snapshot(f"SELECT s.day, {', '.join(f'coalesce(p.{c}, 0) AS {c}' for c in _NAMES)} FROM wspine s LEFT JOIN pda p USING (day)"),
    "bucket_share": on_snapshot(f", b AS ({BUCKETS}) SELECT day, 100.0::DOUBLE * input / t AS input_share, 100.0::DOUBLE * output / t AS output_share, 100.0::DOUBLE * cached / t AS cached_share FROM b, (SELECT greatest(1, max(input + output + cached)) AS t FROM b)"),
    "request_curve": on_snapshot(f", b AS ({BUCKETS}) SELECT day, 100.0::DOUBLE * (row_number() OVER (ORDER BY day) - 1) / 6 AS x, 36.0::DOUBLE - 30.0::DOUBLE * requests / greatest(1, max(requests) OVER ()) AS y FROM b"),
    "compact_number": on_snapshot(f"SELECT session_id, attempt_id, {_COMPACT.format(x='(input_tokens * 37)')} AS small, {_COMPACT.format(x='(started_at * input_tokens)')} AS large FROM selected WHERE input_tokens IS NOT NULL"),
    "exact_number": on_calls("SELECT session_id, attempt_id, CAST(started_at AS VARCHAR) AS plain, format('{:,}', started_at) AS grouped FROM calls"),
    "date_label": on_snapshot("SELECT day, strftime(day::DATE, '%b %-d') AS label FROM spine"),
    "model_label": on_snapshot("SELECT provider, model, provider || ' / ' || model AS long, model AS short FROM pmo"),
    "dup_start": on_log(_INTEGRITY + "kind = 'start' AND was = 'start'", True),
    "orphan_end": on_log(_INTEGRITY + "kind = 'end' AND (was IS NULL OR was = 'end')", True),
    "field_mismatch": on_log(_INTEGRITY + "kind = 'end' AND was = 'start' AND (turn <> was_turn OR step <> was_step OR provider <> was_provider OR model <> was_model)", True),
    "stream_integrity": on_log(_INTEGRITY.replace("SELECT session_id, seq, attempt_id, turn, step FROM att WHERE ", """SELECT session_id, seq, attempt_id, fault FROM (SELECT *, CASE WHEN kind = 'start' THEN CASE WHEN was = 'start' THEN 'dup_start' END WHEN was IS NULL OR was = 'end' THEN 'orphan_end'
  WHEN turn <> was_turn OR step <> was_step OR provider <> was_provider OR model <> was_model THEN 'field_mismatch' END AS fault FROM att) WHERE fault IS NOT NULL"""), True),
    "open_at_end": on_log(_INTEGRITY + "kind = 'start' AND nxt IS NULL", True),
}
