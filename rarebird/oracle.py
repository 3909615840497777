"""DuckDB SQL that recomputes each registered query from the raw driver tables.

Every statement starts from the same ``ev_features`` definition as
``rarebird.sources.fixtures.ev_features`` and is written independently of the
Spark code (plain window functions and joins, the obvious single-node way).
"""

EV = """ev_features AS (
  SELECT e.event_id, e.value,
         CAST(hour(e.ts) AS DOUBLE) AS hr,
         CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS k,
         CAST(u.n AS DOUBLE) AS usr_events,
         round(u.m, 6) AS usr_value,
         1.0e0 AS const,
         CAST(hour(e.ts) < 6 AS INTEGER) AS night,
         CAST(e.user_id % 2 = 0 AS INTEGER) AS even_user,
         CAST(e.value > 50 AS INTEGER) AS big,
         e.event_type AS category,
         CAST(e.event_type = 'error' AS INTEGER) AS label,
         CAST(e.value + CAST(json_extract_string(e.props, '$.k') AS DOUBLE) + 5 * hour(e.ts)
              + e.event_id % 40 > 200 AS INTEGER) AS learn,
         LEAST(CAST(floor(e.value) AS INTEGER), 200) AS score,
         CAST(LEAST(CAST(floor(e.value) AS INTEGER), 200) >= 50 AS INTEGER) AS prediction
  FROM events e
  JOIN (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY user_id) u USING (user_id)
)"""


def with_ev(sql: str, *ctes: str) -> str:
    """Prefix ``sql`` with the ev_features CTE and any further CTEs."""
    parts = [EV, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def md5_int(seed, key_sql: str, salt: str = "") -> str:
    return f"CAST(('0x' || substr(md5('{seed}-{salt}' || CAST({key_sql} AS VARCHAR)), 1, 8)) AS BIGINT)"


def md5_uniform(seed, key_sql: str, salt: str = "") -> str:
    return f"({md5_int(seed, key_sql, salt)} / 4294967296.0e0)"
