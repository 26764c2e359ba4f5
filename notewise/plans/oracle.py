"""Shared SQL fragments of the oracle queries."""

from __future__ import annotations


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


NOTES = """notes AS (
  SELECT *, coalesce(lead(st) OVER (PARTITION BY doc ORDER BY idx) - en, 0) AS dt
  FROM (SELECT doc, idx, n, pitch, st, dur, st + dur AS en, kind
        FROM (SELECT user_id AS doc,
                     row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
                     count(*) OVER (PARTITION BY user_id) AS n,
                     CAST(48 + CAST(floor(value) AS INT) % 37 AS BIGINT) AS pitch,
                     (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 3600000000 AS st,
                     CAST(1 + CAST(json_extract_string(props, '$.k') AS INT) % 24 AS BIGINT) AS dur,
                     event_type AS kind
              FROM events)))"""

ROWS = NOTES + """,
rows_ AS (
  SELECT doc, w, doc || '#' || w AS seq, CAST(idx - 256 * w AS BIGINT) AS i, least(512, n - 256 * w) AS wlen,
         pitch, st, en, dur, greatest(-96, least(95, dt)) AS dt, kind
  FROM (SELECT *, unnest([idx // 256, idx // 256 - 1]) AS w FROM notes)
  WHERE w >= 0 AND idx < 256 * w + 512 AND (w = 0 OR 256 * (w - 1) + 512 < n) AND least(512, n - 256 * w) >= 16)"""


def hash_sql(op: str, seed: int, *keys: str) -> str:
    inner = ", ".join([f"'{op}'", f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return stable_hash_sql(f"concat_ws('|', {inner})")


def stable_hash_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % 2147483647)"


def uniform_sql(op: str, seed: int, *keys: str) -> str:
    return f"(CAST({hash_sql(op, seed, *keys)} AS DOUBLE) / CAST(2147483647 AS DOUBLE))"


def uniform_int_sql(op: str, seed: int, low, high, *keys: str) -> str:
    return f"CAST(({low}) + floor({uniform_sql(op, seed, *keys)} * (({high}) - ({low}) + 1)) AS BIGINT)"


def normal_sql(op: str, seed: int, *keys: str) -> str:
    u, v = uniform_sql(op + ".a", seed, *keys), uniform_sql(op + ".b", seed, *keys)
    return f"(sqrt(-2.0 * ln(CAST(1 AS DOUBLE) - {u})) * cos(2 * pi() * {v}))"


def discrete_sql(cdf, u: str) -> str:
    whens = " ".join(f"WHEN {u} < CAST({upto!r} AS DOUBLE) THEN {value}" for value, upto in cdf[:-1])
    return f"(CASE {whens} ELSE {cdf[-1][0]} END)" if whens else str(cdf[-1][0])
