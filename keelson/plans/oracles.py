"""Independent DuckDB SQL for each registered query (the correctness oracles).

Written from the rules, not from the Spark code: windows, ASOF joins and
recursive CTEs where Spark uses block folds, bucketed range joins and Arrow
folds.  Column names match the Spark queries exactly.
"""

from __future__ import annotations

from keelson.functions.fnv import duckdb_fnv_sql
from keelson.sources.fixtures import (DUCK_BATCHES, DUCK_BIG_PAYLOADS, DUCK_IDLE, DUCK_OUTCOMES, DUCK_RING_KEYS,
                                      DUCK_SAMPLES, DUCK_VERSIONS, TEST_SECRET, duck_arrivals, duck_hmac)

ARR = duck_arrivals(TEST_SECRET)


def _hmac_ok(rel: str = "") -> str:
    p = f"{rel}payload"
    body = f"unhex(left(hex({p}), 2 * (octet_length({p}) - 32)))"
    msg = (f"encode({rel}event_id || {rel}user_id || {rel}event_type || CAST({rel}ts AS VARCHAR)) || {body}")
    return (f"CASE WHEN octet_length({p}) >= 33 THEN right(hex({p}), 64) = hex({duck_hmac(msg)}) "
            f"ELSE false END")


def verdict_ctes(src: str = "arrivals") -> str:
    """CTEs v_flag, v_surv, verdict over relation ``src`` (event columns + seq)."""
    return f"""
    v_flag AS (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1 AS dedup_ok,
             {_hmac_ok()} AS hmac_ok
      FROM {src}),
    v_surv AS (
      SELECT seq, -quantile_disc(-ts, 0.5) OVER w AS median, count(*) OVER w AS window_rows
      FROM v_flag WHERE dedup_ok
      WINDOW w AS (ORDER BY seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
    v_drift AS (
      SELECT f.*, s.median, s.window_rows,
             CASE WHEN f.dedup_ok THEN (s.window_rows < 10 OR abs(f.ts - s.median) <= 3600000) END AS drift_ok
      FROM v_flag f LEFT JOIN v_surv s ON f.seq = s.seq),
    verdict AS (
      SELECT *, dedup_ok AND coalesce(drift_ok, false) AND hmac_ok AS passed,
             CASE WHEN NOT dedup_ok THEN 'dedup' WHEN NOT drift_ok THEN 'watermark'
                  WHEN NOT hmac_ok THEN 'hmac' ELSE '' END AS stage,
             CASE WHEN NOT dedup_ok THEN 'duplicate event_id: ' || event_id
                  WHEN NOT drift_ok THEN 'timestamp too far from watermark'
                  WHEN NOT hmac_ok THEN 'hmac verification failed' ELSE '' END AS reason
      FROM v_drift)"""


def ring_ctes(nodes_sql: str, name: str = "ring") -> str:
    """CTE ``{name}(h, node)``: one point per distinct hash, smallest node on ties."""
    return f"""
    {name}_pts AS (
      SELECT {duckdb_fnv_sql("node || '#' || CAST(vnode AS VARCHAR)")} AS h, node
      FROM (SELECT node, unnest(range(150)) AS vnode FROM ({nodes_sql}))),
    {name} AS (SELECT h, min(node) AS node FROM {name}_pts GROUP BY h)"""


def lookup_sql(keys_rel: str, key_col: str, ring: str, out_col: str) -> str:
    """SELECT keys.*, node: first point with hash >= key hash, wrapping to the first point."""
    return f"""
      SELECT k.*, coalesce(r.node, (SELECT node FROM {ring} ORDER BY h LIMIT 1), '') AS {out_col}
      FROM (SELECT *, {duckdb_fnv_sql(key_col)} AS _kh FROM {keys_rel}) k
      ASOF LEFT JOIN {ring} r ON k._kh <= r.h"""


def breaker_ctes(calls: str, fth: int, timeout: int, sth: int) -> str:
    """Recursive CTE ``bk`` stepping every sink one call at a time (rn order by seq)."""
    return f"""
    bc AS (SELECT sink, seq, t, ok, row_number() OVER (PARTITION BY sink ORDER BY seq) AS rn FROM {calls}),
    bk(sink, rn, seq, allowed, state, fc, sc, lf) AS (
      SELECT DISTINCT sink, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), 'CLOSED', 0, 0,
             CAST(0 AS BIGINT)
      FROM bc
      UNION ALL
      SELECT sink, rn, seq, allowed,
             CASE WHEN NOT allowed THEN ps
                  WHEN ok THEN CASE WHEN ps = 'HALF_OPEN' AND psc + 1 >= {sth} THEN 'CLOSED' ELSE ps END
                  ELSE CASE WHEN ps = 'CLOSED' AND pfc + 1 >= {fth} THEN 'OPEN'
                            WHEN ps = 'HALF_OPEN' THEN 'OPEN' ELSE ps END END,
             CASE WHEN NOT allowed THEN pfc
                  WHEN ok THEN CASE WHEN ps = 'HALF_OPEN' AND psc + 1 >= {sth} THEN 0 ELSE pfc END
                  ELSE CASE WHEN ps = 'CLOSED' AND pfc + 1 >= {fth} THEN 0
                            WHEN ps = 'HALF_OPEN' THEN 0 ELSE pfc + 1 END END,
             CASE WHEN NOT allowed THEN psc
                  WHEN ok THEN CASE WHEN ps = 'HALF_OPEN' AND psc + 1 >= {sth} THEN 0
                                    WHEN ps = 'HALF_OPEN' THEN psc + 1 ELSE psc END
                  ELSE CASE WHEN ps = 'CLOSED' AND pfc + 1 >= {fth} THEN 0
                            WHEN ps = 'HALF_OPEN' THEN 0 ELSE psc END END,
             CASE WHEN allowed AND NOT ok THEN t ELSE plf END
      FROM (
        SELECT c.sink, c.rn, c.seq, c.t, c.ok,
               CASE WHEN b.state = 'OPEN' AND c.t - b.lf >= {timeout} THEN 'HALF_OPEN' ELSE b.state END AS ps,
               CASE WHEN b.state = 'OPEN' AND c.t - b.lf >= {timeout} THEN 0 ELSE b.fc END AS pfc,
               CASE WHEN b.state = 'OPEN' AND c.t - b.lf >= {timeout} THEN 0 ELSE b.sc END AS psc,
               b.lf AS plf,
               NOT (b.state = 'OPEN' AND c.t - b.lf < {timeout}) AS allowed
        FROM bk b JOIN bc c ON c.sink = b.sink AND c.rn = b.rn + 1))"""


HOT_STORE_UP = "((ts // 60000) % 60) >= 3"      # the hot store is down 3 minutes each hour


def routed_ctes(src: str = "arrivals", tenants: tuple[str, ...] = ("tenant_a", "tenant_b", "tenant_c")) -> str:
    """verdict + tenant + path + breaker-driven fallback -> CTE ``routed`` (all verdict rows)."""
    nodes = " UNION ALL ".join(f"SELECT '{t}' AS node" for t in tenants)
    return f"""{verdict_ctes(src)},
    {ring_ctes(nodes, 'tring')},
    r_ten AS ({lookup_sql("(SELECT * FROM verdict WHERE passed)", "user_id", "tring", "tenant")}),
    r_path AS (SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase', 'add_to_cart')
                              THEN 'hot' ELSE 'cold' END AS path FROM r_ten),
    hot_calls AS (SELECT 'hot' AS sink, seq, ts AS t, {HOT_STORE_UP} AS ok FROM r_path WHERE path = 'hot'),
    {breaker_ctes("hot_calls", 5, 30000, 2)},
    r_deliv AS (SELECT p.*, b.allowed, b.allowed AND c.ok AS delivered
                FROM r_path p LEFT JOIN bk b ON b.seq = p.seq AND b.rn > 0
                LEFT JOIN hot_calls c ON c.seq = p.seq),
    routed AS (
      SELECT *, path = 'hot' AND NOT coalesce(delivered, false) AS fallback,
             CASE WHEN path = 'hot' AND NOT coalesce(delivered, false) THEN 'cold' ELSE path END AS effective_path
      FROM r_deliv)"""


def _w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


_WIRE = f"""{ARR},
    wire_src AS (SELECT *, CAST(substr(event_id, 2) AS BIGINT) % 71 = 9 AS truncated FROM arrivals)"""

_COLD_ROWS = "SELECT event_id, user_id, event_type, platform, ts, seq FROM routed WHERE passed AND effective_path = 'cold'"

ORACLES: dict[str, str] = {
    "admit_events": _w(DUCK_BIG_PAYLOADS) + """
      SELECT doc_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
             octet_length(payload) <= 65536 AS admitted,
             CASE WHEN octet_length(payload) <= 65536 THEN 'ok' ELSE 'payload too large (>64KB)' END AS message
      FROM big_payloads""",
    "admit_batches": _w(DUCK_BATCHES) + """
      SELECT batch_id, count(*) AS n_events,
             CAST(CASE WHEN count(*) <= 1000 THEN count(*) FILTER (WHERE payload_size <= 65536) ELSE 0 END
                  AS BIGINT) AS accepted,
             count(*) <= 1000 AS success,
             CASE WHEN count(*) <= 1000 THEN 'batch:' || CAST(count(*) FILTER (WHERE payload_size <= 65536) AS VARCHAR)
                  ELSE 'batch too large (>1000 events)' END AS message
      FROM batches GROUP BY batch_id""",
    "codec_roundtrip": _w(_WIRE) + """
      SELECT seq, NOT truncated AS decode_ok,
             CASE WHEN NOT truncated THEN event_id END AS event_id,
             CASE WHEN NOT truncated THEN user_id END AS user_id,
             CASE WHEN NOT truncated THEN platform END AS platform,
             CASE WHEN NOT truncated THEN event_type END AS event_type,
             CASE WHEN NOT truncated THEN ts END AS ts,
             CASE WHEN NOT truncated THEN hex(payload) END AS payload_hex
      FROM wire_src""",
    "filter_compatible": _w(DUCK_VERSIONS) + """
      SELECT seq, schema_version FROM versions WHERE schema_version IN (1, 2, 3)""",
    "union_sources": _w(ARR) + """
      SELECT seq, event_id, CASE WHEN seq % 4 < 2 THEN 'rpc' ELSE 'topic' END AS source FROM arrivals""",
    "dedup_first": _w(ARR) + """
      SELECT event_id, seq, row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1 AS dedup_ok
      FROM arrivals""",
    "dedup_idle_ttl": _w(ARR, DUCK_IDLE, """
    i_rows AS MATERIALIZED (
      SELECT event_id, seq, t, lag(seq) OVER (PARTITION BY event_id ORDER BY seq) AS prev FROM idle_arrivals),
    epochs(b) AS (
      SELECT min(seq) FROM i_rows
      UNION ALL
      SELECT * FROM (
        SELECT min(seq) AS b FROM (
          SELECT r.seq, r.t, max(CASE WHEN r.prev IS NULL OR r.prev < e.b THEN r.t END)
                   OVER (ORDER BY r.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_add
          FROM epochs e JOIN i_rows r ON r.seq >= e.b)
        WHERE t - last_add >= 3600000) WHERE b IS NOT NULL)""") + """
      SELECT event_id, seq, t, prev IS NULL OR prev < b AS dedup_ok
      FROM i_rows ASOF JOIN epochs ON seq >= b""",
    "dedup_last_n": _w(ARR, """
    f_rows AS MATERIALIZED (SELECT event_id, seq, row_number() OVER (ORDER BY seq) AS rn FROM arrivals),
    fifo(rn, seq, event_id, dedup_ok, ids) AS (
      SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), CAST([] AS VARCHAR[])
      UNION ALL
      SELECT r.rn, r.seq, r.event_id, NOT list_contains(f.ids, r.event_id),
             CASE WHEN list_contains(f.ids, r.event_id) THEN f.ids
                  WHEN len(f.ids) = 100 THEN list_append(f.ids[2:], r.event_id) ELSE list_append(f.ids, r.event_id) END
      FROM fifo f JOIN f_rows r ON r.rn = f.rn + 1)""") + """
      SELECT event_id, seq, dedup_ok FROM fifo WHERE rn > 0""",
    "rolling_median": _w(ARR, verdict_ctes()) + """
      SELECT seq, ts, CAST(median AS BIGINT) AS median, CAST(window_rows AS INTEGER) AS window_rows
      FROM v_drift WHERE dedup_ok""",
    "drift_filter": _w(ARR, verdict_ctes()) + """
      SELECT seq, ts, drift_ok FROM v_drift WHERE dedup_ok""",
    "hmac_sign": _w("""
      unsigned AS (SELECT 'e' || event_id AS event_id, 'acct-' || user_id AS user_id, event_type,
                          CAST(1704067200000 + event_id * 1000 AS BIGINT) AS ts, encode(props) AS body
                   FROM events)""") + f"""
      SELECT event_id, hex(body || {duck_hmac("encode(event_id || user_id || event_type || CAST(ts AS VARCHAR)) || body")})
             AS payload_hex
      FROM unsigned""",
    "hmac_verify": _w(ARR) + f"""
      SELECT event_id, seq, {_hmac_ok()} AS hmac_ok FROM arrivals""",
    "split_payload": _w(ARR) + """
      SELECT seq,
             CASE WHEN octet_length(payload) >= 32 THEN left(hex(payload), 2 * (octet_length(payload) - 32)) END
               AS body_hex,
             CASE WHEN octet_length(payload) >= 32 THEN right(hex(payload), 64) END AS mac_hex
      FROM arrivals""",
    "flag_platform": _w(ARR) + """
      SELECT seq, platform, platform IN ('ios', 'android', 'web') AS platform_known FROM arrivals""",
    "quality_verdict": _w(ARR, verdict_ctes()) + """
      SELECT event_id, seq, passed, stage, reason FROM verdict""",
    "quality_counters": _w(ARR, verdict_ctes()) + """
      SELECT count(*) AS total, count(*) FILTER (WHERE NOT passed) AS rejected,
             count(*) FILTER (WHERE stage = 'dedup') AS dedup_rejected,
             count(*) FILTER (WHERE stage = 'watermark') AS watermark_rejected,
             count(*) FILTER (WHERE stage = 'hmac') AS hmac_rejected,
             count(*) FILTER (WHERE passed) AS passed
      FROM verdict""",
    "classify_path": _w(ARR) + """
      SELECT seq, event_type,
             CASE WHEN event_type IN ('click', 'view', 'purchase', 'add_to_cart') THEN 'hot' ELSE 'cold' END AS path
      FROM arrivals""",
    "fnv1a64": _w(DUCK_RING_KEYS) + f"""
      SELECT key, {duckdb_fnv_sql("key")} AS hash FROM ring_keys""",
    "build_ring": _w("""
      sup AS (SELECT s_name AS node, unnest(range(150)) AS vnode FROM supplier)""") + f"""
      SELECT {duckdb_fnv_sql("node || '#' || CAST(vnode AS VARCHAR)")} AS hash, node, CAST(vnode AS INTEGER) AS vnode
      FROM sup""",
    "ring_lookup": _w(DUCK_RING_KEYS, ring_ctes("SELECT s_name AS node FROM supplier")) + f"""
      SELECT key, node FROM ({lookup_sql("ring_keys", "key", "ring", "node")})""",
    "moved_keys": _w(DUCK_RING_KEYS, ring_ctes("SELECT s_name AS node FROM supplier", "r1"),
                     ring_ctes("SELECT s_name AS node FROM supplier WHERE s_suppkey <> 1", "r2"),
                     f"b AS ({lookup_sql('ring_keys', 'key', 'r1', 'node_before')})",
                     f"a AS ({lookup_sql('(SELECT key, node_before FROM b)', 'key', 'r2', 'node_after')})") + """
      SELECT key, node_before, node_after FROM a WHERE node_before <> node_after""",
    "assign_tenant": _w(ARR, ring_ctes("SELECT 'tenant_a' AS node UNION ALL SELECT 'tenant_b' UNION ALL "
                                       "SELECT 'tenant_c'", "tring")) + f"""
      SELECT seq, user_id, tenant FROM ({lookup_sql("(SELECT seq, user_id FROM arrivals)", "user_id", "tring", "tenant")})""",
    "breaker_timeline": _w(DUCK_OUTCOMES, breaker_ctes("outcomes", 5, 86400000, 2)) + """
      SELECT sink, seq, allowed, state, CAST(fc AS INTEGER) AS failure_count,
             CAST(sc AS INTEGER) AS success_count
      FROM bk WHERE rn > 0""",
    "breaker_blocks": _w(DUCK_OUTCOMES, "one_sink AS (SELECT 'hot' AS sink, seq, t, ok FROM outcomes)", breaker_ctes("one_sink", 5, 86400000, 2)) + """
      SELECT sink, seq, allowed, state, CAST(fc AS INTEGER) AS failure_count,
             CAST(sc AS INTEGER) AS success_count
      FROM bk WHERE rn > 0""",
    "hot_with_fallback": _w(ARR, routed_ctes()) + """
      SELECT seq, path, fallback, effective_path FROM routed""",
    "route_stats": _w(ARR, routed_ctes()) + """
      SELECT count(*) FILTER (WHERE path = 'hot') AS hot_count, count(*) FILTER (WHERE path = 'cold') AS cold_count,
             count(*) FILTER (WHERE fallback) AS hot_fallback_cold
      FROM routed""",
    "project_hot": _w(ARR, routed_ctes()) + """
      SELECT event_id, user_id, event_type, platform, CAST(ts AS VARCHAR) AS ts
      FROM routed WHERE effective_path = 'hot'""",
    "project_cold": _w(ARR, routed_ctes()) + """
      SELECT event_id, user_id, event_type, platform, ts FROM routed WHERE effective_path = 'cold'""",
    "dead_letter_json": _w(ARR, routed_ctes()) + """
      SELECT '{"event_id":"' || event_id || '","user_id":"' || user_id || '","event_type":"' || event_type
             || '","platform":"' || platform || '","ts":' || CAST(ts AS VARCHAR) || '}' AS line
      FROM routed WHERE effective_path = 'cold'""",
    "replay_dead_letter": _w(ARR, routed_ctes()) + """
      SELECT event_id, user_id, event_type, platform, ts
      FROM routed WHERE effective_path = 'cold' AND (seq // 2) % 8 = 3""",
    "latency_stats": _w(DUCK_SAMPLES) + """
      SELECT event_type, count(*) AS n, round(avg(latency_us), 3) AS avg,
             list_sort(list(latency_us))[CAST(floor(count(*) * 50 / 100) AS BIGINT) + 1] AS p50,
             list_sort(list(latency_us))[CAST(floor(count(*) * 95 / 100) AS BIGINT) + 1] AS p95,
             list_sort(list(latency_us))[CAST(floor(count(*) * 99 / 100) AS BIGINT) + 1] AS p99,
             list_sort(list(latency_us))[least(count(*) - 1, CAST(floor(count(*) * 999 / 1000) AS BIGINT)) + 1]
               AS p999,
             max(latency_us) AS max
      FROM samples WHERE latency_us >= 0 GROUP BY event_type""",
    "throughput": _w(DUCK_SAMPLES) + """
      SELECT count(*) AS sent, count(*) FILTER (WHERE latency_us >= 0) AS success,
             count(*) FILTER (WHERE latency_us < 0) AS failed,
             round((max(t) - min(t)) / 1000.0, 3) AS elapsed_s,
             CASE WHEN max(t) > min(t) THEN round(count(*) / ((max(t) - min(t)) / 1000.0), 3) END AS qps
      FROM samples""",
    "interval_stats": _w(ARR, routed_ctes(), """
    allrows AS (SELECT seq, ts, passed, effective_path FROM routed
                UNION ALL SELECT seq, ts, passed, NULL FROM verdict WHERE NOT passed),
    per AS (SELECT ts - (ts % 5000) AS interval_start,
                   count(*) FILTER (WHERE passed) AS routed,
                   count(*) FILTER (WHERE passed AND effective_path = 'hot') AS hot,
                   count(*) FILTER (WHERE passed AND effective_path = 'cold') AS cold,
                   count(*) FILTER (WHERE NOT passed) AS rejected
            FROM allrows GROUP BY 1)""") + """
      SELECT interval_start, routed, hot, cold, rejected,
             CAST(sum(routed) OVER w AS BIGINT) AS total_routed, CAST(sum(hot) OVER w AS BIGINT) AS total_hot,
             CAST(sum(cold) OVER w AS BIGINT) AS total_cold, CAST(sum(rejected) OVER w AS BIGINT) AS total_rejected
      FROM per WINDOW w AS (ORDER BY interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "run_batch": _w(_WIRE, "decoded AS (SELECT * EXCLUDE (truncated) FROM wire_src WHERE NOT truncated)",
                    routed_ctes("decoded")) + """
      SELECT seq, event_id, passed, stage, tenant, path, effective_path FROM routed
      UNION ALL SELECT seq, event_id, passed, stage, NULL, NULL, NULL FROM verdict WHERE NOT passed
      UNION ALL SELECT seq, NULL, false, 'decode', NULL, NULL, NULL FROM wire_src WHERE truncated""",
    "dedup_stream": _w(ARR) + """
      SELECT event_id, seq, row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1 AS dedup_ok
      FROM arrivals""",
    "drift_stream": _w(ARR, verdict_ctes()) + """
      SELECT event_id, drift_ok FROM v_drift WHERE dedup_ok""",
    "run_stream": _w(_WIRE, "decoded AS (SELECT * EXCLUDE (truncated) FROM wire_src WHERE NOT truncated)",
                     verdict_ctes("decoded")) + """
      SELECT seq, event_id, passed, stage, reason FROM verdict
      UNION ALL SELECT seq, '', false, 'decode', '' FROM wire_src WHERE truncated""",
    "engine_counters": _w(_WIRE, "decoded AS (SELECT * EXCLUDE (truncated) FROM wire_src WHERE NOT truncated)",
                          verdict_ctes("decoded")) + """
      SELECT count(*) AS total, count(*) FILTER (WHERE NOT passed) AS rejected,
             count(*) FILTER (WHERE stage = 'dedup') AS dedup_rejected,
             count(*) FILTER (WHERE stage = 'watermark') AS watermark_rejected,
             count(*) FILTER (WHERE stage = 'hmac') AS hmac_rejected,
             count(*) FILTER (WHERE passed) AS passed,
             (SELECT count(*) FROM wire_src WHERE truncated) AS decode_rejected,
             count(*) FILTER (WHERE NOT passed) + (SELECT count(*) FROM wire_src WHERE truncated) AS engine_rejected
      FROM verdict""",
    "event_files": _w(ARR) + """
      SELECT event_id, user_id, platform, event_type, ts, hex(payload) AS payload_hex FROM arrivals""",
    "event_topic": _w(_WIRE, "decoded AS (SELECT * EXCLUDE (truncated) FROM wire_src WHERE NOT truncated)",
                      verdict_ctes("decoded")) + """
      , numbered AS (SELECT seq, truncated, row_number() OVER (ORDER BY seq) - 1 AS place FROM wire_src)
      SELECT place AS seq, event_id, passed, stage FROM verdict JOIN numbered USING (seq)
      UNION ALL SELECT place, '', false, 'decode' FROM numbered WHERE truncated""",
    "stream_counters": _w(_WIRE, "decoded AS (SELECT * EXCLUDE (truncated) FROM wire_src WHERE NOT truncated)",
                          routed_ctes("decoded")) + """
      SELECT (SELECT count(*) FROM verdict) AS total, (SELECT count(*) FROM verdict WHERE NOT passed) AS rejected,
             (SELECT count(*) FROM verdict WHERE stage = 'dedup') AS dedup_rejected,
             (SELECT count(*) FROM verdict WHERE stage = 'watermark') AS watermark_rejected,
             (SELECT count(*) FROM verdict WHERE stage = 'hmac') AS hmac_rejected,
             (SELECT count(*) FROM verdict WHERE passed) AS passed,
             (SELECT count(*) FROM wire_src WHERE truncated) AS decode_rejected,
             (SELECT count(*) FROM verdict WHERE NOT passed) + (SELECT count(*) FROM wire_src WHERE truncated) AS engine_rejected,
             count(*) FILTER (WHERE path = 'hot') AS hot_count, count(*) FILTER (WHERE path = 'cold') AS cold_count,
             count(*) FILTER (WHERE path = 'hot' AND effective_path = 'cold') AS hot_fallback_cold,
             count(*) FILTER (WHERE effective_path = 'cold') AS rows_flushed, CAST(0 AS BIGINT) AS rows_dead_lettered
      FROM routed""",
    "interval_stats_stream": _w(ARR, routed_ctes(), """
    allrows AS (SELECT seq, passed, effective_path FROM routed
                UNION ALL SELECT seq, passed, NULL FROM verdict WHERE NOT passed),
    arrived AS (SELECT *, seq * 100 - (seq % 7) * 9000 AS t FROM allrows),
    per AS (SELECT t - ((t % 5000) + 5000) % 5000 AS interval_start,
                   count(*) FILTER (WHERE passed) AS routed,
                   count(*) FILTER (WHERE passed AND effective_path = 'hot') AS hot,
                   count(*) FILTER (WHERE passed AND effective_path = 'cold') AS cold,
                   count(*) FILTER (WHERE NOT passed) AS rejected
            FROM arrived GROUP BY 1)""") + """
      SELECT interval_start, routed, hot, cold, rejected,
             CAST(sum(routed) OVER w AS BIGINT) AS total_routed, CAST(sum(hot) OVER w AS BIGINT) AS total_hot,
             CAST(sum(cold) OVER w AS BIGINT) AS total_cold, CAST(sum(rejected) OVER w AS BIGINT) AS total_rejected
      FROM per WINDOW w AS (ORDER BY interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "latency_sketch": _w(DUCK_SAMPLES) + """
      SELECT event_type, count(*) AS n, round(avg(latency_us), 3) AS avg, max(latency_us) AS max,
             true AS p50_ok, true AS p95_ok, true AS p99_ok, true AS p999_ok
      FROM samples WHERE latency_us >= 0 GROUP BY event_type""",
    "split_paths": _w(ARR) + """
      SELECT seq, CASE WHEN event_type IN ('click', 'view', 'purchase', 'add_to_cart') THEN 'hot' ELSE 'cold' END AS branch
      FROM arrivals""",
    "write_hot": _w(ARR) + """
      SELECT '7-' || seq AS log_id, event_id, user_id, event_type, platform, CAST(ts AS VARCHAR) AS ts FROM arrivals""",
    "flush_accounting": _w(ARR) + """
      SELECT count(*) AS rows_written FROM arrivals""",
}
