"""The mutation log and its segments."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidelog.functions import varint_size
from tidelog.operators.fold import frame, ordered
from tidelog.schema import MAX_KEY_LEN

SEGMENT_ROWS = 1000


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of the events table: errors delete a user's key, all else sets it."""
    tomb = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"),
        F.format_string("u/%06d", "user_id").alias("key"),
        F.when(~tomb, F.col("props")).alias("value"),
        tomb.alias("tomb"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tomb = F.col("o_orderstatus") == "F"
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("seq"),
        F.format_string("c/%08d", "o_custkey").alias("key"),
        F.when(~tomb, F.col("o_orderpriority")).alias("value"),
        tomb.alias("tomb"),
    )


def validate(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): keys are 1 to 4096 bytes and every row has a seq."""
    reason = (
        F.when(F.col("seq").isNull(), "no_seq")
        .when(F.col("key").isNull() | (F.octet_length("key") == 0), "empty_key")
        .when(F.octet_length("key") > MAX_KEY_LEN, "key_too_long")
    )
    marked = log.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def with_segment(log: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Count-based memtables: no global order is needed, so this scales without a shuffle."""
    return log.withColumn("segment", F.expr(f"seq div {rows}"))


def segments_by_bytes(log: DataFrame, writer: str, flush_bytes: int) -> DataFrame:
    """Byte-based memtables of each writer: a table is sealed once what it holds reaches flush_bytes.

    Within a table a key's newest value counts, and a deletion counts its key alone. The
    fold is sequential by definition; its state is one memtable."""

    def step(state: dict, rows):
        segments, used = [], []
        for key, klen, vlen in zip(rows["key"], rows["klen"], rows["vlen"]):
            held = state["held"]
            state["used"] += vlen - held[key] if key in held else klen + vlen
            held[key] = vlen
            segments.append(state["segment"])
            used.append(state["used"])
            if state["used"] >= flush_bytes:
                state |= {"held": {}, "used": 0, "segment": state["segment"] + 1}
        return frame(rows, ["writer", "seq"], segment=segments, bytes_used=used)

    sized = log.select(
        F.expr(writer).cast("long").alias("writer"), "seq", "key",
        F.octet_length("key").alias("klen"),
        F.when(F.col("tomb"), 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0))).alias("vlen"),
    )
    return ordered(sized, "writer", "seq", lambda: {"held": {}, "used": 0, "segment": 0}, step, "writer long, seq long, segment long, bytes_used long")


def last_per(log: DataFrame, *by: str) -> DataFrame:
    """The newest mutation of each group, tombstones included: one shuffle, partial aggregation first."""
    rest = [c for c in log.columns if c not in by]
    newest = F.max_by(F.struct(*rest), "seq")
    return log.groupBy(*by).agg(newest.alias("m")).select(*by, *[f"m.{c}" for c in rest])


def mem_counters(log: DataFrame) -> DataFrame:
    last = last_per(with_segment(log).select("segment", "key", "seq", "value", "tomb"), "segment", "key")
    size = F.octet_length("key") + F.when(F.col("tomb"), 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0)))
    return last.groupBy("segment").agg(F.count("*").alias("entry_count"), F.sum(size.cast("long")).alias("bytes_used"))


def wal_records(log: DataFrame) -> DataFrame:
    """Tag, two varint lengths, key, value and checksum: the bytes of each record."""
    klen = F.octet_length("key").cast("long")
    vlen = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    return log.select(
        "seq", "key", "value", "tomb",
        F.when(F.col("tomb"), 2).otherwise(1).alias("tag"),
        (F.lit(1) + varint_size(klen) + varint_size(vlen) + klen + vlen + 4).cast("long").alias("size"),
    )


def wal_offsets(records: DataFrame, rows: int = SEGMENT_ROWS, buckets: int = 1000) -> DataFrame:
    """Each record's byte offset. Segments' sums are scanned within at most so many buckets of
    neighbouring segments, and the buckets' sums in one task, so no window grows with the log
    beyond one bucket's segments."""
    seg = records.withColumn("segment", F.expr(f"seq div {rows}"))
    sums = seg.groupBy("segment").agg(F.sum("size").alias("seg_size"))
    ends = sums.agg(F.min("segment").alias("lo"), F.max("segment").alias("hi"))
    sums = sums.join(F.broadcast(ends)).withColumn("bucket", F.expr(f"(segment - lo) * {buckets} div (hi - lo + 1)")).drop("lo", "hi")
    per = sums.groupBy("bucket").agg(F.sum("seg_size").alias("bucket_size"))
    whole = per.select(F.col("bucket"), F.coalesce(F.sum("bucket_size").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    before = W.partitionBy("bucket").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    base = sums.join(F.broadcast(whole), "bucket").select("segment", (F.col("above") + F.coalesce(F.sum("seg_size").over(before), F.lit(0))).alias("base"))
    inner = W.partitionBy("segment").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return seg.join(base, "segment").withColumn("offset", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("base", "segment")


def replay(records: DataFrame, checkpoint: int) -> DataFrame:
    """The newest state of every key that a log written after the checkpoint holds."""
    return last_per(records.where(F.col("offset") >= checkpoint).select("seq", "key", "value", "tomb"), "key")


def before_torn(records: DataFrame, bad: str) -> DataFrame:
    """All that lies before the first bad record: its seq is a single minimum, no window needed."""
    first = records.where(F.expr(bad)).agg(F.min("seq").alias("first_bad"))
    return records.join(F.broadcast(first), F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))).drop("first_bad")
