"""DuckDB SQL for every named query, over the same parquet tables.

The SQL states each query's meaning directly (window functions over raw
calls, one row per call and window), not the compacted forms the Spark
plans use, so agreement checks the rewrites too. Parameters are those of
:class:`tallyline.plans.queries.QueryParams`.
"""

from __future__ import annotations


def calls_sql(batch_seconds: int = 3600) -> str:
    width_us = batch_seconds * 1_000_000
    return f"""calls AS (
  SELECT event_id AS vote_id,
         user_id AS phone_number,
         CAST(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS INTEGER) AS contestant_number,
         CAST(epoch_us(ts) // 1000000 AS INTEGER) AS "timestamp",
         ts,
         (epoch_us(ts) - 1704067200000000) // {width_us} AS batch_id
  FROM events)"""


RUNNING = """running AS (
  SELECT *, count(*) OVER (PARTITION BY phone_number ORDER BY batch_id
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM calls)"""

BATCH_ACCEPTED = """batch_acc AS (
  SELECT * FROM running WHERE n <= 20 AND contestant_number <= 6)"""

ARRIVAL_ACCEPTED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY phone_number ORDER BY ts, vote_id) AS rk FROM calls),
acc AS (SELECT * FROM ranked WHERE rk <= 20 AND contestant_number <= 6)"""


def _metric_series(batch_seconds: int) -> str:
    return f"""{calls_sql(batch_seconds)},
counted AS (SELECT batch_id, count(*) AS n FROM calls GROUP BY batch_id),
spine AS (SELECT unnest(generate_series((SELECT min(batch_id) FROM counted),
                                        (SELECT max(batch_id) FROM counted))) AS batch_id),
series AS (
  SELECT s.batch_id,
         make_timestamp((s.batch_id * {batch_seconds} + 1704067200) * 1000000) AS batch_start,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n,
         CAST(coalesce(c.n, 0) * 1000 AS DOUBLE) / CAST({batch_seconds * 1000} AS DOUBLE) AS rate
  FROM spine s LEFT JOIN counted c ON s.batch_id = c.batch_id)"""


def _windows(accepted: str) -> str:
    return f"""fanned AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) - o * INTERVAL '1 hour' AS window_start, contestant_number
  FROM (SELECT ts, contestant_number, unnest(range(5)) AS o FROM {accepted}))
SELECT window_start, window_start + INTERVAL '5 hours' AS window_end, contestant_number,
       count(*) AS n
FROM fanned GROUP BY window_start, contestant_number"""


_RENDER = """concat_ws(' ', vote_id, phone_number, contestant_number, "timestamp")"""

ORACLE_SQL: dict[str, str] = {
    "parse_calls": f"""WITH {calls_sql()},
lines AS (SELECT {_RENDER} AS value FROM calls),
parts AS (SELECT string_split(value, ' ') AS p FROM lines)
SELECT CAST(p[1] AS BIGINT) AS vote_id, CAST(p[2] AS BIGINT) AS phone_number,
       CAST(p[3] AS INTEGER) AS contestant_number, CAST(p[4] AS INTEGER) AS "timestamp"
FROM parts""",

    "valid_contestant_calls": f"""WITH {calls_sql()}
SELECT vote_id, phone_number, contestant_number FROM calls WHERE contestant_number <= 6""",

    "running_call_counts": f"""WITH {calls_sql()}, {RUNNING}
SELECT vote_id, batch_id, n FROM running""",

    "allowed_phones": f"""WITH {calls_sql()}, {RUNNING}
SELECT DISTINCT phone_number, batch_id, n FROM running WHERE n <= 20""",

    "batch_quota": f"""WITH {calls_sql()}, {RUNNING}, {BATCH_ACCEPTED}
SELECT vote_id, contestant_number FROM batch_acc""",

    "batch_quota_join": f"""WITH {calls_sql()}, {RUNNING}, {BATCH_ACCEPTED}
SELECT vote_id, contestant_number FROM batch_acc""",

    "arrival_quota": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED}
SELECT vote_id, contestant_number FROM acc""",

    "contestant_totals_by_batch": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED},
per_batch AS (SELECT contestant_number, batch_id, count(*) AS c FROM acc GROUP BY 1, 2)
SELECT contestant_number, batch_id,
       CAST(sum(c) OVER (PARTITION BY contestant_number ORDER BY batch_id) AS BIGINT) AS total
FROM per_batch""",

    "leaderboard": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED}
SELECT contestant_number, count(*) AS total FROM acc
GROUP BY contestant_number ORDER BY total DESC, contestant_number LIMIT 10""",

    "leaderboard_history": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED},
per_batch AS (SELECT contestant_number, batch_id, count(*) AS c FROM acc GROUP BY 1, 2),
spine AS (SELECT unnest(generate_series((SELECT min(batch_id) FROM per_batch),
                                        (SELECT max(batch_id) FROM per_batch))) AS batch_id),
firsts AS (SELECT contestant_number, min(batch_id) AS first_batch FROM per_batch GROUP BY 1),
grid AS (SELECT s.batch_id, f.contestant_number FROM spine s JOIN firsts f ON s.batch_id >= f.first_batch),
totals AS (
  SELECT g.batch_id, g.contestant_number,
         CAST(sum(coalesce(p.c, 0)) OVER (PARTITION BY g.contestant_number ORDER BY g.batch_id) AS BIGINT) AS total
  FROM grid g LEFT JOIN per_batch p
    ON p.contestant_number = g.contestant_number AND p.batch_id = g.batch_id),
boards AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY total DESC, contestant_number)
                 AS INTEGER) AS rank
  FROM totals)
SELECT batch_id, rank, contestant_number, total FROM boards WHERE rank <= 10""",

    "leaderboard_batch_quota": f"""WITH {calls_sql()}, {RUNNING}, {BATCH_ACCEPTED}
SELECT contestant_number, count(*) AS total FROM batch_acc
GROUP BY contestant_number ORDER BY total DESC, contestant_number LIMIT 10""",

    "window_contestant_counts": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED},
{_windows("acc")}""",

    "window_counts_batch_quota": f"""WITH {calls_sql()}, {RUNNING}, {BATCH_ACCEPTED},
{_windows("batch_acc")}""",

    "vote_kv_latest": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED},
writes AS (
  SELECT CAST(phone_number AS VARCHAR) AS key, {_RENDER} AS value,
         row_number() OVER (PARTITION BY phone_number ORDER BY ts DESC, vote_id DESC) AS rn
  FROM acc)
SELECT key, value FROM writes WHERE rn = 1""",

    "vote_kv_store": f"""WITH {calls_sql()}, {RUNNING}, {BATCH_ACCEPTED}
SELECT CAST(vote_id AS VARCHAR) AS key, {_RENDER} AS value FROM batch_acc""",

    "batch_counts": f"""WITH {_metric_series(3600)}
SELECT batch_id, n FROM series""",

    "batch_rate": f"""WITH {_metric_series(3600)}
SELECT batch_id, batch_start, n, rate FROM series""",

    "rate_stats": f"""WITH {_metric_series(3600)}
SELECT count(rate) AS n_batches, round(max(rate), 9) AS max_rate, round(min(rate), 9) AS min_rate,
       round(avg(rate), 9) AS avg_rate, round(stddev_samp(rate), 9) AS stddev_rate
FROM series
WHERE batch_id <= (SELECT max(batch_id) FROM series) - 4 AND rate <> 0""",

    "idle_batches": f"""WITH {_metric_series(600)},
looked AS (
  SELECT batch_id,
         sum(rate) OVER (ORDER BY batch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3,
         row_number() OVER (ORDER BY batch_id) AS samples
  FROM series)
SELECT batch_id FROM looked WHERE samples > 3 AND last3 = 0""",

    "idle_runs": f"""WITH {_metric_series(600)},
looked AS (
  SELECT batch_id,
         sum(rate) OVER (ORDER BY batch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3,
         row_number() OVER (ORDER BY batch_id) AS samples
  FROM series),
idle AS (SELECT batch_id, batch_id - row_number() OVER (ORDER BY batch_id) AS stretch
         FROM looked WHERE samples > 3 AND last3 = 0)
SELECT min(batch_id) AS first, max(batch_id) AS last FROM idle GROUP BY stretch""",

    "window_counts_any_slide": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED},
fanned AS (
  SELECT time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - o * INTERVAL '3 hours' AS window_start,
         ts, contestant_number
  FROM (SELECT ts, contestant_number, unnest(range(3)) AS o FROM acc))
SELECT window_start, window_start + INTERVAL '7 hours' AS window_end, contestant_number, count(*) AS n
FROM fanned WHERE ts < window_start + INTERVAL '7 hours' GROUP BY window_start, contestant_number""",

    "word_counts": r"""WITH lines AS (
  SELECT doc_id // 100 AS batch_id,
         unnest(CASE WHEN text = '' THEN []::VARCHAR[]
                     ELSE string_split_regex(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n')
                END) AS line
  FROM documents),
words AS (
  SELECT batch_id,
         unnest(CASE WHEN line <> '' AND rtrim(line, ' ') = '' THEN []::VARCHAR[]
                     ELSE string_split(rtrim(line, ' '), ' ') END) AS word
  FROM lines)
SELECT batch_id, word, count(*) AS n FROM words GROUP BY batch_id, word""",
}
