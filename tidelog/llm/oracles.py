"""DuckDB SQL for the rows of op4, op7 and op10, written from their definitions."""

from tidelog.llm import secrets, sharding

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: A run of windows that follow each other in item and document is one match; r windows of eight words are r + 7 words.
OP4 = f"""WITH D AS (SELECT row_number() OVER () AS row, doc_id, {WORDS('text')} AS w FROM documents),
  I AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS name, {WORDS('text')} AS w FROM benchmark) WHERE len(w) > 0),
  V AS (SELECT item, name, spot, least(len(w), 8) AS n, list_slice(w, spot, spot + least(len(w), 8) - 1) AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS spot FROM I)),
  S AS (SELECT DISTINCT n, win[1] AS first FROM V),
  T AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM D),
  C AS (SELECT row, pos, n, list_slice(w, pos, pos + n - 1) AS win FROM T JOIN S ON word = first WHERE pos + n - 1 <= len(w)),
  M AS (SELECT row, pos, C.n, item, name, spot FROM C JOIN V ON V.n = C.n AND V.win = C.win),
  L AS (SELECT row, max(n) AS longest FROM (SELECT row, max(n) + count(*) - 1 AS n FROM (SELECT *, spot - row_number() OVER (PARTITION BY row, item, pos - spot ORDER BY spot) AS island FROM M) GROUP BY row, item, pos - spot, island) GROUP BY row),
  H AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(pos, pos + n)) AS p FROM M) GROUP BY row),
  N AS (SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, name FROM M) GROUP BY row)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
  FROM D LEFT JOIN H USING (row) LEFT JOIN N USING (row) LEFT JOIN L USING (row)"""

quoted = lambda s: s.replace("'", "''")
#: Either case of ASCII letters alone, and no possessive repeat, which gives nothing back here anyway.
_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_PATTERNS = [secrets.BASE[0][1].removeprefix("(?i)").replace("password|passwd|secret|token|api_?key", _EITHER), secrets.BASE[1][1], "[0-9a-f]+", secrets.CANDIDATE]
_MATCHES = lambda k: f"""SELECT row, {k} AS rank, unnest(found) AS found, unnest(list_slice(gaps, 1, len(found))) AS gap, unnest(range(len(found))) AS spot
    FROM (SELECT row, regexp_extract_all(text, '{quoted(_PATTERNS[k])}') AS found, string_split_regex(text, '{quoted(_PATTERNS[k])}') AS gaps FROM D)"""  # noqa: E731
_ALLOWED = " OR ".join(f"regexp_matches(found, '{quoted(p.replace('*+', '*'))}')" for p in secrets.ALLOW)
_LEAST = " ".join(f"WHEN regexp_matches(found, '{quoted(p)}') THEN {least}" for _, p, least in secrets.CLASSES)

OP7 = f"""WITH D AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
  A AS ({' UNION ALL '.join(_MATCHES(k) for k in range(len(_PATTERNS)))}),
  P AS (SELECT row, rank, found, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY row, rank ORDER BY spot) AS BIGINT) AS stop FROM A),
  B AS (SELECT row, rank, stop - length(found) AS start, stop FROM P WHERE (rank = 0 AND length(regexp_extract(found, '{quoted(_PATTERNS[0])}', 2)) >= 12) OR (rank = 1 AND length(found) >= 18) OR (rank = 2 AND length(found) >= 16)),
  X AS (SELECT row, stop - length(found) AS start, found, CASE {_LEAST} END AS least FROM P WHERE rank = 3 AND NOT ({_ALLOWED})),
  W AS (SELECT row, start, i, list_aggregate(list_slice(chars, i, i + {secrets.WINDOW - 1}), 'entropy') >= least - 1e-9 AS high
    FROM (SELECT *, string_split(found, '') AS chars, unnest(range(1, length(found) - {secrets.WINDOW - 2})) AS i FROM X)),
  E AS (SELECT *, sum(CASE WHEN i - before <= {secrets.WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY row, start ORDER BY i) AS stretch FROM (SELECT *, lag(i) OVER (PARTITION BY row, start ORDER BY i) AS before FROM W WHERE high)),
  Z AS (SELECT row, 3 AS rank, start + min(i) - 1 AS start, start + max(i) + {secrets.WINDOW - 1} AS stop FROM E GROUP BY row, start, stretch),
  F AS (SELECT * FROM B UNION ALL SELECT row, rank, start, stop FROM Z WHERE NOT EXISTS (SELECT 1 FROM B WHERE B.row = Z.row AND B.start <= Z.start AND B.stop >= Z.stop)),
  S AS (SELECT row, count(CASE WHEN rank = 0 THEN 1 END) AS a, count(CASE WHEN rank = 1 THEN 1 END) AS c, count(CASE WHEN rank = 2 THEN 1 END) AS h,
      string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
    FROM (SELECT *, ['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || start || ':' || stop AS span FROM F) GROUP BY row)
  SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM D LEFT JOIN S USING (row)"""

_SHARDS = b"".join(k.to_bytes(2, "big") for k in sharding.fill([f"shard-{k:04d}" for k in range(sharding.SHARDS)])).hex()
OP10 = f"""SELECT doc_id, source, n_bytes, slot, CAST(concat('0x', substr('{_SHARDS}', 4 * slot + 1, 4)) AS INTEGER) AS shard FROM (
  SELECT doc_id, source, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 12)) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)"""

ORACLES: dict[str, str] = {"op4_decontamination": OP4, "op7_secret_scan": OP7, "op10_sharding": OP10}
