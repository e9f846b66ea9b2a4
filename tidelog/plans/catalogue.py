"""Named queries over the driver's tables and, where SQL can say the same, that SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog import functions as fn
from tidelog.operators import bloom, compact, http, log as L, runs as R, trace, view
from tidelog.sources import blocks
from tidelog.streaming import ingest

LOG = """L AS (SELECT event_id AS seq, 'u/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_type = 'error' AS tomb,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, ts, event_id // 1000 AS segment FROM events)"""
RANKED = f"""{LOG}, N AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM L)"""
RUNS = f"""{LOG}, R AS (SELECT segment AS run_id, key, seq, value, tomb, ts FROM (SELECT *, row_number() OVER (PARTITION BY segment, key ORDER BY seq DESC) AS rn FROM L) WHERE rn = 1)"""
PROBES = "P AS (SELECT DISTINCT 'u/' || lpad(CAST(e.event_id AS VARCHAR), 6, '0') AS key FROM events e)"
SIZE = lambda x: f"(CASE {' '.join(f'WHEN {x} < {1 << 7 * k} THEN {k}' for k in range(1, 9))} ELSE 9 END)"
VLEN = "CASE WHEN tomb THEN 0 ELSE coalesce(strlen(value), 0) END"
WAL = f"""{LOG}, S AS (SELECT seq, key, value, tomb, CASE WHEN tomb THEN 2 ELSE 1 END AS tag,
  CAST(1 + {SIZE('strlen(key)')} + {SIZE('coalesce(strlen(value), 0)')} + strlen(key) + coalesce(strlen(value), 0) + 4 AS BIGINT) AS size FROM L),
  O AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM S)"""
LAYOUT = f"""{RUNS}, E AS (SELECT run_id, key, CAST(8 + strlen(key) + {VLEN} AS BIGINT) AS entry, row_number() OVER (PARTITION BY run_id ORDER BY key) AS rn FROM R),
  B AS (SELECT run_id, key, entry, rn, CAST(0 AS BIGINT) AS block_no, entry AS used FROM E WHERE rn = 1
    UNION ALL SELECT e.run_id, e.key, e.entry, e.rn, b.block_no + CASE WHEN b.used + e.entry > {R.BLOCK_TARGET} THEN 1 ELSE 0 END,
      CASE WHEN b.used + e.entry > {R.BLOCK_TARGET} THEN e.entry ELSE b.used + e.entry END FROM B b JOIN E e ON e.run_id = b.run_id AND e.rn = b.rn + 1),
  I AS (SELECT run_id, block_no, max(key) AS last_key, CAST(sum(entry) + 20 AS BIGINT) AS block_size FROM B GROUP BY run_id, block_no),
  X AS (SELECT *, CAST(coalesce(sum(block_size) OVER (PARTITION BY run_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM I)"""
PARAMS = """M AS (SELECT run_id, n, m, CAST(least(32, greatest(1, ceil(m / CAST(n AS DOUBLE) * ln(2)))) AS BIGINT) AS k FROM (
  SELECT run_id, n, CAST(8 * greatest(1.0, ceil(-(greatest(n, 1) * ln(0.01)) / (ln(2) * ln(2)) / 8)) AS BIGINT) AS m FROM (SELECT run_id, count(*) AS n FROM R GROUP BY run_id)))"""
HASH = lambda at: f"CAST(concat('0x', substr(md5(key), {at}, 12)) AS BIGINT)"
CHECKPOINT = 10_000


def _log(spark, d):
    return L.from_events(spark, d)


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.format_string("u/%06d", "event_id").alias("key")).distinct()


def _runs(spark, d):
    return R.run_rows(_log(spark, d))


def _wal(spark, d):
    return L.wal_offsets(L.wal_records(_log(spark, d)))


def _accesses(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.pmod("user_id", F.lit(4)).alias("cache_id"), F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), F.format_string("u/%06d", "user_id").alias("key"), (F.pmod("event_id", F.lit(7)) * 100 + 50).cast("long").alias("bytes"))


def _requests(spark, d):
    live = view.live(_log(spark, d)).select("key")
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.pmod("event_id", F.lit(16))
    verb = F.element_at(F.array(*[F.lit(v) for v in ("GET", "PUT", "DELETE", "GET", "POST", "GET", "PATCH", "GET", "PUT", "GET", "POST", "GET", "POST", "PATCH", "POST", "PATCH")]), (n + 1).cast("int"))
    user = F.format_string("u%%2F%06d", "user_id")
    target = (
        F.when(n <= 3, F.concat(F.lit("/v1/kv/"), user)).when(n == 4, F.lit("/admin/flush")).when(n == 5, F.lit("/healthz?probe=1"))
        .when(n == 6, F.lit("/admin/stats")).when(n == 7, F.lit("/v1/kv/a%ZZ")).when(n == 8, F.concat(F.lit("/v1/kv/big"), user))
        .when(n.isin(9, 12), F.lit("/v1/kv/")).when(n == 10, F.lit("/v1/kv/x")).when(n == 13, F.lit("/v1/kv/a%ZZ")).when(n == 15, F.concat(F.lit("/v1/kv/"), user)).otherwise(F.concat(F.lit("/v1/kv/"), F.repeat(F.lit("k"), 4097))))
    return e.select(F.col("event_id").alias("id"), verb.alias("method"), target.alias("target"), (n == 8).alias("body_too_large")), live


def _cas(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return trace.cas(e.select(F.col("event_type").alias("object"), F.col("event_id").alias("seq"), F.format_string("w%d", F.pmod("user_id", F.lit(2))).alias("writer"), F.expr("greatest(event_id div 100 + user_id % 3 - 1, 0)").alias("expected_gen")))


def _ledger(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.pmod("user_id", F.lit(4)).alias("ledger"), F.col("event_id").alias("seq"), F.when(F.pmod("event_id", F.lit(3)) == 2, "free").otherwise("alloc").alias("op"), (F.pmod("event_id", F.lit(7)) * 100 + 50).cast("long").alias("bytes"))


def _index_blocks(spark, d):
    """Index blocks, seven of eight damaged: cut, with another magic, version or flag, or in their first entry."""
    whole = blocks.index_blocks(R.sparse_index(R.block_layout(_runs(spark, d))))
    put = lambda at, digits: F.concat(F.substring(F.col("block"), F.lit(1), at), F.unhex(F.lit(digits)), F.substring(F.col("block"), at + len(digits) // 2 + 1, F.octet_length("block")))
    heap, n = blocks.HEADER + 4 * blocks.number(F.col("block"), 8, 4), F.pmod("run_id", F.lit(8))
    damaged = (
        F.when(n == 1, F.substring(F.col("block"), F.lit(1), F.lit(10))).when(n == 2, put(F.lit(0), "FF")).when(n == 3, put(F.lit(4), "02")).when(n == 4, put(F.lit(6), "01"))
        .when(n == 5, F.substring(F.col("block"), F.lit(1), F.octet_length("block") - 1)).when(n == 6, put(F.lit(blocks.HEADER), "FFFFFFFF")).when(n == 7, put(heap + 12, "0110")).otherwise(F.col("block")))
    read = whole.select("run_id", damaged.alias("block")).select("run_id", blocks.parsed_index(F.col("block")).alias("p"))
    return read.select("run_id", F.col("p.error").alias("error"), F.posexplode_outer("p.entries").alias("place", "e")).select("run_id", "error", "place", F.col("e.error").alias("entry_error"), "e.key", "e.block_offset", "e.block_size")


def _data_blocks(spark, d):
    block = _log(spark, d).select("seq", blocks.with_checksum(F.coalesce("value", "key").cast("binary")).alias("block"))
    n = F.pmod("seq", F.lit(5))
    damaged = F.when(n == 1, F.concat(F.unhex(F.lit("00")), F.substring(F.col("block"), F.lit(2), F.octet_length("block")))).when(n == 2, F.substring(F.col("block"), F.lit(1), F.lit(3))).otherwise(F.col("block"))
    return block.select("seq", damaged.alias("block")).select("seq", blocks.checked(F.col("block")).alias("c")).select("seq", "c.error", F.col("c.payload").cast("string").alias("payload"))


QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


LIVE = "SELECT key, value, seq FROM N WHERE rn = 1 AND NOT tomb"
NEW = "A AS (SELECT * FROM N WHERE rn = 1)"
register("kv_live_view", f"WITH {RANKED} {LIVE}")(lambda s, d: view.live(_log(s, d)))
register("kv_live_view_orders", """SELECT key, value, seq FROM (SELECT 'c/' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS key, o_orderkey AS seq, o_orderstatus = 'F' AS tomb,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND NOT tomb""")(lambda s, d: view.live(L.from_orders(s, d)))
register("kv_point_get", f"WITH {RANKED} {LIVE} AND key = 'u/000007'")(lambda s, d: view.point_get(_log(s, d), "u/000007"))
STATE = "CASE WHEN a.tomb IS NULL THEN 'absent' WHEN a.tomb THEN 'tombstone' ELSE 'present' END AS state"
register("kv_multi_get", f"WITH {RANKED}, {NEW}, {PROBES} SELECT p.key, {STATE}, CASE WHEN NOT a.tomb THEN a.value END AS value FROM P p LEFT JOIN A a ON a.key = p.key")(lambda s, d: view.lookup(_log(s, d), _probes(s, d)))
register("kv_lookup_state", f"WITH {RANKED}, {NEW}, {PROBES} SELECT state, count(*) AS keys FROM (SELECT {STATE} FROM P p LEFT JOIN A a ON a.key = p.key) GROUP BY state")(lambda s, d: view.lookup(_log(s, d), _probes(s, d)).groupBy("state").agg(F.count("*").alias("keys")))
register("kv_missing_keys", f"WITH {RANKED}, {PROBES} SELECT key FROM P WHERE NOT EXISTS (SELECT 1 FROM N WHERE N.key = P.key AND rn = 1 AND NOT tomb)")(lambda s, d: view.missing(_log(s, d), _probes(s, d)))
register("kv_resurrected_keys", f"WITH {LOG} SELECT key, seq, value FROM (SELECT *, lag(tomb) OVER (PARTITION BY key ORDER BY seq) AS was FROM L) WHERE was AND NOT tomb")(lambda s, d: view.resurrected(_log(s, d)))
register("kv_read_tier", f"WITH {LOG}, T AS (SELECT max(segment) AS top FROM L) SELECT key, max(segment) AS segment, CASE max(segment) WHEN (SELECT top FROM T) THEN 'active' WHEN (SELECT top - 1 FROM T) THEN 'frozen' ELSE 'run' END AS tier FROM L GROUP BY key")(lambda s, d: view.read_tier(_log(s, d)))
register("kv_read_amplification", f"WITH {LOG}, G AS (SELECT segment, min(key) AS lo, max(key) AS hi FROM L GROUP BY segment), H AS (SELECT key, max(segment) AS hit FROM L GROUP BY key) SELECT key, hit, count(segment) AS newer, count(CASE WHEN key BETWEEN lo AND hi THEN 1 END) AS newer_in_range FROM H LEFT JOIN G ON segment > hit GROUP BY key, hit")(lambda s, d: view.read_amplification(_log(s, d)))
register("kv_range_scan", f"WITH {RANKED} {LIVE} AND key BETWEEN 'u/000003' AND 'u/000060'")(lambda s, d: view.range_scan(_log(s, d), "u/000003", "u/000060"))
register("stats_snapshot", f"WITH {LOG}, T AS (SELECT max(segment) AS top FROM L) SELECT count(DISTINCT CASE WHEN segment < top THEN segment END) AS sstables, count(DISTINCT CASE WHEN segment = top THEN key END) AS active_entries, CAST(0 AS BIGINT) AS compaction_failures FROM L, T")(lambda s, d: view.stats(_log(s, d)))
register("stats_json", f"WITH {LOG}, T AS (SELECT max(segment) AS top FROM L) SELECT '{{\"sstables\":' || count(DISTINCT CASE WHEN segment < top THEN segment END) || ',\"active_entries\":' || count(DISTINCT CASE WHEN segment = top THEN key END) || ',\"compaction_failures\":0}}' AS body FROM L, T")(lambda s, d: view.stats(_log(s, d)).select(F.to_json(F.struct("*")).alias("body")))
register("mem_segment_count", f"WITH {LOG} SELECT segment, count(*) AS writes, min(seq) AS first_seq, max(seq) AS last_seq FROM L GROUP BY segment")(lambda s, d: L.with_segment(_log(s, d)).groupBy("segment").agg(F.count("*").alias("writes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")))
register("mem_segment_bytes", f"""WITH RECURSIVE {LOG}, E AS (SELECT CAST(substr(key, 3) AS BIGINT) % 4 AS writer, seq, key, strlen(key) AS klen, {VLEN} AS vlen FROM L),
  N AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY seq) AS rn FROM E), P AS (SELECT *, lag(rn) OVER k AS was, lag(vlen) OVER k AS had FROM N WINDOW k AS (PARTITION BY writer, key ORDER BY seq)),
  S AS (SELECT writer, seq, rn, CAST(0 AS BIGINT) AS segment, rn AS since, CAST(klen + vlen AS BIGINT) AS used FROM P WHERE rn = 1
    UNION ALL SELECT p.writer, p.seq, p.rn, CASE WHEN s.used >= 2048 THEN s.segment + 1 ELSE s.segment END, CASE WHEN s.used >= 2048 THEN p.rn ELSE s.since END,
      CASE WHEN s.used >= 2048 THEN p.klen + p.vlen WHEN p.was >= s.since THEN s.used + p.vlen - p.had ELSE s.used + p.klen + p.vlen END
    FROM S s JOIN P p ON p.writer = s.writer AND p.rn = s.rn + 1) SELECT writer, seq, segment, used AS bytes_used FROM S""")(lambda s, d: L.segments_by_bytes(_log(s, d), "pmod(cast(substr(key, 3) as bigint), 4)", 2048))
register("mem_counters", f"WITH {RUNS} SELECT run_id AS segment, count(*) AS entry_count, CAST(sum(strlen(key) + {VLEN}) AS BIGINT) AS bytes_used FROM R GROUP BY run_id")(lambda s, d: L.mem_counters(_log(s, d)))
register("run_rows", f"WITH {RUNS} SELECT run_id, key, seq, value, tomb FROM R")(lambda s, d: _runs(s, d).select("run_id", "key", "seq", "value", "tomb"))
register("run_footer_stats", f"WITH {RUNS} SELECT run_id, count(*) AS entry_count, CAST(sum(strlen(key) + {VLEN}) AS BIGINT) AS payload_bytes FROM R GROUP BY run_id")(lambda s, d: R.footer_stats(_runs(s, d)))
register("run_key_ranges", f"WITH {RUNS} SELECT run_id, min(key) AS key_min, max(key) AS key_max FROM R GROUP BY run_id")(lambda s, d: R.key_ranges(_runs(s, d)))
register("run_manifest", f"WITH {RUNS} SELECT run_id AS id, 'sstables/' || lpad(CAST(run_id AS VARCHAR), 6, '0') || '.sst' AS object_path, min(key) AS key_min, max(key) AS key_max, epoch_us(max(ts)) // 1000 AS created_at_ms FROM R GROUP BY run_id")(lambda s, d: R.manifest(_runs(s, d)))
register("run_next_id", f"WITH {RUNS} SELECT max(run_id) + 1 AS next_id FROM R")(lambda s, d: _runs(s, d).agg((F.max("run_id") + 1).alias("next_id")))
register("run_block_layout", f"WITH RECURSIVE {LAYOUT} SELECT run_id, block_no, key, entry AS entry_bytes FROM B")(lambda s, d: R.block_layout(_runs(s, d)))
register("run_sparse_index", f"WITH RECURSIVE {LAYOUT} SELECT run_id, block_no, last_key, block_size, block_offset FROM X")(lambda s, d: R.sparse_index(R.block_layout(_runs(s, d))))
register("run_index_lower_bound", f"""WITH RECURSIVE {LAYOUT}, {PROBES} SELECT r.run_id, p.key, min(x.last_key) AS found_key, min(x.block_offset) AS found_offset
  FROM P p CROSS JOIN (SELECT DISTINCT run_id FROM X) r LEFT JOIN X x ON x.run_id = r.run_id AND x.last_key >= p.key GROUP BY r.run_id, p.key""")(lambda s, d: R.lower_bound(R.sparse_index(R.block_layout(_runs(s, d))), _probes(s, d)))
register("index_block_parse", f"""WITH RECURSIVE {LAYOUT}, K AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY last_key) - 1 AS i,
    CASE WHEN run_id % 8 IN (1, 5) THEN 'BufferTooSmall' WHEN run_id % 8 = 2 THEN 'BadMagic' WHEN run_id % 8 = 3 THEN 'UnsupportedVersion' WHEN run_id % 8 = 4 THEN 'BadFlags' END AS error FROM X)
  SELECT run_id, error, CAST(CASE WHEN error IS NULL THEN i END AS INTEGER) AS place, entry_error, CASE WHEN good THEN last_key END AS key, CASE WHEN good THEN block_offset END AS block_offset, CASE WHEN good THEN block_size END AS block_size
  FROM (SELECT *, error IS NULL AND entry_error IS NULL AS good FROM (SELECT *, CASE WHEN i = 0 AND run_id % 8 = 6 THEN 'OffsetOutOfRange' WHEN i = 0 AND run_id % 8 = 7 THEN 'KeyTooLong' END AS entry_error FROM K)) WHERE error IS NULL OR i = 0""")(_index_blocks)
register("data_block_check", f"WITH {LOG} SELECT seq, CASE WHEN seq % 5 IN (1, 2) THEN 'BadDataBlock' END AS error, CASE WHEN seq % 5 NOT IN (1, 2) THEN coalesce(value, key) END AS payload FROM L")(_data_blocks)
register("run_file_size", f"""WITH RECURSIVE {LAYOUT}, {PARAMS} SELECT x.run_id, CAST(sum(block_size) + 16 + max(m) // 8 + 16 + 4 * count(*) + sum(strlen(last_key) + 14) + 64 AS BIGINT) AS size_bytes
  FROM X x JOIN M ON M.run_id = x.run_id GROUP BY x.run_id""")(lambda s, d: (lambda r: R.file_size(r, R.sparse_index(R.block_layout(r))))(_runs(s, d)))
register("compact_full", f"WITH {RANKED} SELECT key, segment AS run_id, seq, value, tomb FROM N WHERE rn = 1 AND NOT tomb")(lambda s, d: compact.merge(_runs(s, d), drop_tombstones=True))
register("compact_keep_tombstones", f"WITH {RANKED} SELECT key, segment AS run_id, seq, value, tomb FROM N WHERE rn = 1")(lambda s, d: compact.merge(_runs(s, d)))
register("compact_partial", f"WITH {RUNS} SELECT run_id, key, seq, value, tomb FROM R WHERE run_id NOT BETWEEN 2 AND 5 UNION ALL SELECT 5, key, seq, value, tomb FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM R WHERE run_id BETWEEN 2 AND 5) WHERE rn = 1")(lambda s, d: compact.partial(_runs(s, d), 2, 5))
register("compact_shadowed_versions", f"WITH {RUNS} SELECT run_id, count(CASE WHEN run_id < top THEN 1 END) AS shadowed, count(*) AS entries FROM (SELECT *, max(run_id) OVER (PARTITION BY key) AS top FROM R) GROUP BY run_id")(lambda s, d: compact.shadowed(_runs(s, d)))
register("compact_trigger_schedule", """WITH RECURSIVE T AS (SELECT CAST(1 AS BIGINT) AS flush_no, FALSE AS merges, CAST(1 AS BIGINT) AS runs_after
  UNION ALL SELECT flush_no + 1, runs_after + 1 >= 4, CASE WHEN runs_after + 1 >= 4 THEN 1 ELSE runs_after + 1 END FROM T WHERE flush_no < 50) SELECT * FROM T""")(lambda s, d: compact.trigger_schedule(s, 50, 4))
register("compact_key_range", f"WITH {RUNS} SELECT min(key) AS key_min, max(key) AS key_max FROM R")(lambda s, d: compact.key_range(_runs(s, d)))
register("compact_orphans", f"WITH {RUNS} SELECT 'sstables/' || lpad(CAST(i AS VARCHAR), 6, '0') || '.sst' AS object_path FROM range(0, 40) t(i) WHERE i NOT IN (SELECT run_id FROM R)")(lambda s, d: compact.orphans(s.range(40).select(fn.object_path(F.col("id")).alias("object_path")), R.manifest(_runs(s, d))))
register("wal_record_sizes", f"WITH {WAL} SELECT seq, tag, size FROM S")(lambda s, d: L.wal_records(_log(s, d)).select("seq", "tag", "size"))
register("wal_offsets", f'WITH {WAL} SELECT seq, size, "offset" FROM O')(lambda s, d: _wal(s, d).select("seq", "size", "offset"))
register("wal_replay_from_checkpoint", f"""WITH {WAL} SELECT key, seq, value, tomb FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM O WHERE "offset" >= {CHECKPOINT}) WHERE rn = 1""")(lambda s, d: L.replay(_wal(s, d), CHECKPOINT))
register("wal_torn_tail", f"WITH {WAL} SELECT seq, key, tag FROM S WHERE seq < (SELECT min(seq) FROM S WHERE seq % 997 = 996)")(lambda s, d: L.before_torn(L.wal_records(_log(s, d)), "seq % 997 = 996").select("seq", "key", "tag"))
register("fn_varint_size", f"SELECT o_orderkey AS n, CAST({SIZE('o_orderkey * o_orderkey')} AS BIGINT) AS size FROM orders")(lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), fn.varint_size(F.col("o_orderkey") * F.col("o_orderkey")).alias("size")))
register("fn_varint_encode", """SELECT n, CASE WHEN n < 128 THEN lpad(hex(n), 2, '0') WHEN n < 16384 THEN hex(n % 128 + 128) || lpad(hex(n // 128), 2, '0')
  ELSE hex(n % 128 + 128) || hex(n // 128 % 128 + 128) || lpad(hex(n // 16384), 2, '0') END AS encoded FROM (SELECT o_orderkey AS n FROM orders)""")(lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), fn.varint_encode(F.col("o_orderkey")).alias("encoded")))
register("fn_crc32c", f"""WITH {LOG}, T AS (SELECT list(c ORDER BY i) AS crc_table FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR x IN range(0, 8)]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 2197175160) ELSE a // 2 END) AS c FROM range(0, 256) r(i))),
  B AS (SELECT seq, hex(encode(coalesce(value, key))) AS digits FROM L)
  SELECT seq, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(concat('0x', substr(digits, 2 * k + 1, 2)) AS BIGINT) FOR k IN range(0, len(digits) // 2)]), lambda a, b: xor(crc_table[xor(a % 256, b) + 1], a // 256)), 4294967295) AS crc FROM B, T""")(lambda s, d: _log(s, d).select("seq", fn.crc32c(F.coalesce("value", "key")).alias("crc")))
register("fn_percent_decode", "SELECT page_id, url_decode(replace(split_part(url, '?', 1), '+', '%2B')) AS path FROM pages")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", fn.percent_decode(fn.strip_query(F.col("url"))).alias("path")))
register("fn_url_encode", "SELECT page_id, replace(url_encode(url), '%2F', '/') AS encoded FROM pages")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", fn.percent_encode_path(F.col("url")).alias("encoded")))
register("fn_range_header", "SELECT o_orderkey AS id, 'bytes=' || o_orderkey || '-' || (o_orderkey + o_custkey) AS header, o_orderkey AS first, o_orderkey + o_custkey AS last FROM orders")(lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), fn.range_header(F.col("o_orderkey"), F.col("o_custkey") + 1).alias("header")).withColumn("r", fn.parse_range(F.col("header"))).select("id", "header", "r.first", "r.last"))
register("fn_parse_port", "SELECT o_orderkey AS id, CASE WHEN o_orderkey * 7 <= 65535 THEN CAST(o_orderkey * 7 AS INTEGER) END AS port FROM orders")(lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), fn.parse_port((F.col("o_orderkey") * 7).cast("string")).alias("port")))
register("fn_pack_le", "SELECT o_orderkey AS n, lpad(hex(o_orderkey % 256), 2, '0') || lpad(hex(o_orderkey // 256 % 256), 2, '0') || lpad(hex(o_orderkey // 65536 % 256), 2, '0') || lpad(hex(o_orderkey // 16777216), 2, '0') AS packed, o_orderkey AS back FROM orders")(lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), fn.pack_le(F.col("o_orderkey"), 4).alias("packed")).withColumn("back", fn.unpack_le(F.col("packed"), 4)))
register("error_status", "SELECT event_id AS id, CAST(CASE event_id % 4 WHEN 0 THEN 503 WHEN 1 THEN 400 ELSE 500 END AS INTEGER) AS status FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), http.error_status(F.element_at(F.array(*[F.lit(x) for x in ("OutOfMemory", "KeyTooLong", "Conflict", "Io")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))).alias("status")))
register("http_status", f"""WITH {RANKED}, A AS (SELECT key FROM N WHERE rn = 1 AND NOT tomb), Q AS (SELECT event_id AS id, event_id % 16 AS n, 'u/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key FROM events)
  SELECT id, CAST(CASE WHEN n IN (1, 2) THEN 204 WHEN n IN (0, 3) THEN CASE WHEN key IN (SELECT key FROM A) THEN 200 ELSE 404 END WHEN n = 4 THEN 204 WHEN n = 5 THEN 200 WHEN n = 6 THEN 405
    WHEN n = 7 THEN 400 WHEN n = 8 THEN 413 WHEN n = 9 THEN 400 WHEN n IN (10, 15) THEN 405 ELSE 400 END AS INTEGER) AS status FROM Q""")(lambda s, d: http.status(*_requests(s, d)))
register("bloom_params", f"WITH {RUNS}, {PARAMS} SELECT run_id, n, m, k FROM M")(lambda s, d: bloom.build(_runs(s, d))[0])
register("bloom_probe", f"""WITH {RUNS}, {PARAMS}, {PROBES}, W AS (SELECT DISTINCT run_id, ({HASH(1)} + i * {HASH(13)}) % m AS bit FROM (SELECT r.run_id, r.key, m, unnest(range(0, k)) AS i FROM R r JOIN M ON M.run_id = r.run_id)),
  Z AS (SELECT run_id, key, m, unnest(range(0, k)) AS i FROM P, M), C AS (SELECT z.run_id, z.key, count(*) = count(w.bit) AS candidate FROM Z z LEFT JOIN W w ON w.run_id = z.run_id AND w.bit = ({HASH(1).replace('key', 'z.key')} + z.i * {HASH(13).replace('key', 'z.key')}) % z.m GROUP BY z.run_id, z.key)
  SELECT run_id, count(*) AS probes, count(CASE WHEN candidate THEN 1 END) AS candidates, count(CASE WHEN candidate AND present THEN 1 END) AS hits, count(CASE WHEN candidate AND NOT present THEN 1 END) AS false_positives
  FROM (SELECT c.*, EXISTS (SELECT 1 FROM R r WHERE r.run_id = c.run_id AND r.key = c.key) AS present FROM C c) GROUP BY run_id""")(lambda s, d: (lambda r: bloom.false_positives(*bloom.build(r), r, _probes(s, d)))(_runs(s, d)))
ACC = "A AS (SELECT user_id % 4 AS cache_id, event_type AS stream, event_id AS seq, 'u/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key FROM events), S AS (SELECT *, lead(key) OVER (PARTITION BY stream ORDER BY seq) AS next_key FROM A)"
register("prefetch_transitions", f"WITH {ACC} SELECT stream, key, arg_max(next_key, seq) AS next_key, count(*) AS transitions FROM S WHERE next_key <> key GROUP BY stream, key")(lambda s, d: trace.prefetch_transitions(_accesses(s, d)))
register("prefetch_predictions", f"WITH {ACC} SELECT stream, seq, key, last_value(CASE WHEN next_key <> key THEN next_key END IGNORE NULLS) OVER (PARTITION BY stream, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted, next_key FROM S")(lambda s, d: trace.prefetch_predictions(_accesses(s, d)))
register("lru_hits", f"""WITH {ACC}, P AS (SELECT *, lag(seq) OVER (PARTITION BY cache_id, key ORDER BY seq) AS prev FROM A)
  SELECT p.cache_id, p.seq, p.prev IS NOT NULL AND count(DISTINCT q.key) < 16 AS hit FROM P p LEFT JOIN A q ON q.cache_id = p.cache_id AND q.seq > p.prev AND q.seq < p.seq GROUP BY p.cache_id, p.seq, p.prev""")(lambda s, d: trace.lru(_accesses(s, d), 16))
register("block_cache_hits", """WITH RECURSIVE A AS (SELECT user_id % 4 AS cache_id, event_id AS seq, 'u/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CAST(event_id % 7 * 100 + 50 AS BIGINT) AS bytes,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn FROM events),
  C AS (SELECT cache_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, '' AS outcome, CAST([] AS VARCHAR[]) AS keys, CAST([] AS BIGINT[]) AS sizes FROM A WHERE rn = 1
    UNION ALL SELECT cache_id, rn, seq, outcome, CASE outcome WHEN 'hit' THEN list_append(list_concat(list_slice(keys, 1, spot - 1), list_slice(keys, spot + 1, len(keys))), key) WHEN 'miss' THEN list_append(list_slice(keys, gone + 1, len(keys)), key) ELSE keys END,
      CASE outcome WHEN 'hit' THEN list_append(list_concat(list_slice(sizes, 1, spot - 1), list_slice(sizes, spot + 1, len(sizes))), sizes[spot]) WHEN 'miss' THEN list_append(list_slice(sizes, gone + 1, len(sizes)), bytes) ELSE sizes END
    FROM (SELECT a.cache_id, a.rn, a.seq, a.key, a.bytes, c.keys, c.sizes, list_position(c.keys, a.key) AS spot, CASE WHEN list_contains(c.keys, a.key) THEN 'hit' WHEN a.bytes > 4000 THEN 'refused' ELSE 'miss' END AS outcome,
      (SELECT min(i) FROM range(0, len(c.sizes) + 1) t(i) WHERE coalesce(list_sum(list_slice(c.sizes, i + 1, len(c.sizes))), 0) + a.bytes <= 4000) AS gone FROM C c JOIN A a ON a.cache_id = c.cache_id AND a.rn = c.rn + 1))
  SELECT cache_id, seq, outcome, CAST(coalesce(list_sum(sizes), 0) AS BIGINT) AS used FROM C WHERE rn > 0""")(lambda s, d: trace.byte_lru(_accesses(s, d), 4000))
register("admission_ledger", """WITH RECURSIVE E AS (SELECT user_id % 4 AS ledger, event_id AS seq, event_id % 3 = 2 AS free, CAST(event_id % 7 * 100 + 50 AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn FROM events),
  S AS (SELECT ledger, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, TRUE AS ok, CAST(0 AS BIGINT) AS live, CAST(0 AS BIGINT) AS refused FROM E WHERE rn = 1
    UNION ALL SELECT e.ledger, e.rn, e.seq, e.free OR s.live + e.bytes <= 2000, CASE WHEN e.free THEN greatest(0, s.live - e.bytes) WHEN s.live + e.bytes <= 2000 THEN s.live + e.bytes ELSE s.live END,
      s.refused + CASE WHEN e.free OR s.live + e.bytes <= 2000 THEN 0 ELSE 1 END FROM S s JOIN E e ON e.ledger = s.ledger AND e.rn = s.rn + 1)
  SELECT ledger, seq, ok, live, refused FROM S WHERE rn > 0""")(lambda s, d: trace.admission(_ledger(s, d), 2000))
register("manifest_cas", """WITH RECURSIVE E AS (SELECT event_type AS object, event_id AS seq, 'w' || (user_id % 2) AS writer, greatest(event_id // 100 + user_id % 3 - 1, 0) AS expected_gen,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
  G AS (SELECT object, rn, CAST(0 AS BIGINT) AS gen, expected_gen AS expects FROM E WHERE rn = 1
    UNION ALL SELECT e.object, e.rn, g.gen + CASE WHEN g.expects = g.gen THEN 1 ELSE 0 END, e.expected_gen FROM G g JOIN E e ON e.object = g.object AND e.rn = g.rn + 1)
  SELECT e.object, e.seq, e.writer, e.expected_gen, CASE WHEN e.expected_gen = g.gen THEN 'committed' ELSE 'conflict' END AS outcome FROM E e JOIN G g ON g.object = e.object AND g.rn = e.rn""")(_cas)
register("stream_live_view", f"WITH {RANKED} {LIVE}")(ingest.live_view)
