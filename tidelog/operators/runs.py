"""Immutable sorted runs: contents, statistics, block layout and sparse index."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.functions import object_path
from tidelog.operators.bloom import with_params
from tidelog.operators.fold import frame, ordered
from tidelog.operators.log import last_per, with_segment

BLOCK_TARGET = 512
BLOCK_OVERHEAD = 20  # header of 16 and checksum of 4
FOOTER = 64
CHUNK = 4096  # probes in one list
RUN_PARTS = 4  # partitions of runs that each partition of probes meets


def run_rows(log: DataFrame) -> DataFrame:
    """What a flush of each segment writes: the newest mutation of every key, tombstones included."""
    cols = ["segment", "key", "seq", "value", "tomb"] + (["ts"] if "ts" in log.columns else [])
    return last_per(with_segment(log).select(*cols), "segment", "key").withColumnRenamed("segment", "run_id")


def _vlen():
    return F.when(F.col("tomb"), 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0)))


def footer_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.count("*").alias("entry_count"), F.sum((F.octet_length("key") + _vlen()).cast("long")).alias("payload_bytes"))


def key_ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.min("key").alias("key_min"), F.max("key").alias("key_max"))


def manifest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(
        F.min("key").alias("key_min"), F.max("key").alias("key_max"), F.unix_millis(F.max("ts")).alias("created_at_ms")
    ).select(F.col("run_id").alias("id"), object_path("run_id").alias("object_path"), "key_min", "key_max", "created_at_ms")


def block_layout(rows: DataFrame, target: int = BLOCK_TARGET) -> DataFrame:
    """Each entry's block. Blocks roll greedily: one closes when the next entry would pass the target.

    A run is sorted and streams through one task, which holds the open block's size alone."""
    sized = rows.select("run_id", "key", (F.lit(8) + F.octet_length("key") + _vlen()).cast("long").alias("entry_bytes"))

    def step(state: dict, part):
        out, block, used = [], state["block"], state["used"]
        for entry in part["entry_bytes"].tolist():
            if used and used + entry > target:
                block, used = block + 1, 0
            used += entry
            out.append(block)
        state |= {"block": block, "used": used}
        return frame(part, ["run_id", "key", "entry_bytes"], block_no=out)[["run_id", "block_no", "key", "entry_bytes"]]

    return ordered(sized, "run_id", "key", lambda: {"block": 0, "used": 0}, step, "run_id long, block_no long, key string, entry_bytes long")


def sparse_index(layout: DataFrame) -> DataFrame:
    """Last key, offset and size of each block."""
    blocks = layout.groupBy("run_id", "block_no").agg(F.max("key").alias("last_key"), (F.sum("entry_bytes") + BLOCK_OVERHEAD).alias("block_size"))
    before = W.partitionBy("run_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("block_offset", F.coalesce(F.sum("block_size").over(before), F.lit(0).cast("long")))


def _intervals(index: DataFrame) -> DataFrame:
    """One row for each run: what its index answers, as intervals (above, last_key] in order; the last has no end and finds nothing."""
    known = F.array_sort(F.collect_list(F.struct("last_key", "block_offset")))
    none = F.array(F.lit(None).cast("struct<last_key:string,block_offset:bigint>"))
    pair = lambda p, e: F.struct(p["last_key"].alias("above"), e["last_key"].alias("last_key"), e["block_offset"].alias("block_offset"))
    return index.groupBy("run_id").agg(known.alias("known")).select("run_id", F.zip_with(F.concat(none, "known"), F.concat("known", none), pair).alias("intervals"))


def _chunks(probes: DataFrame) -> DataFrame:
    """The probes' distinct keys in sorted lists of at most CHUNK, a null in a list of its own.

    Neighbours share a list, so most lists lie within one interval of most runs."""
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = probes.select("key").distinct().repartitionByRange(n, "key")

    def work(batches):
        for batch in batches:
            held = batch.column(0).cast(pa.large_string())
            for part in (held.filter(held.is_null()), held.filter(held.is_valid())):
                for at in range(0, len(part), CHUNK):
                    piece = part.slice(at, CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array([piece.to_pylist()], pa.list_(pa.string()))], ["keys"])

    return keys.sortWithinPartitions("key").mapInArrow(work, "keys array<string>")


def _stretches(intervals: Column, keys: Column) -> Column:
    """The intervals that hold any of the sorted keys, each with the places [start, end) of its keys.

    Both places are found together, bit by bit: one step is one walk over the intervals that are left."""
    first, last = F.get(keys, F.lit(0)), F.element_at(keys, -1)
    begun = lambda e: e["above"].isNull() | (e["above"] < last)
    open_ = lambda e: e["last_key"].isNull() | (e["last_key"] >= first)
    found = F.filter(intervals, lambda e: F.when(first.isNull(), e["last_key"].isNull()).otherwise(begun(e) & open_(e)))
    found = F.transform(found, lambda e: e.withField("start", F.lit(0)).withField("end", F.when(e["last_key"].isNull(), F.size(keys)).otherwise(0)))

    def seek(step: int):
        on = lambda at, key: at + F.when(F.get(keys, at + (step - 1)) <= key, step).otherwise(0)
        return lambda e: F.struct(e["last_key"].alias("last_key"), e["block_offset"].alias("block_offset"), e["above"].alias("above"), on(e["start"], e["above"]).alias("start"), on(e["end"], e["last_key"]).alias("end"))

    for k in reversed(range(CHUNK.bit_length())):
        found = F.transform(found, seek(1 << k))
    return found


def lower_bound(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The first indexed key that isn't below each probe, in every run; null past the last.

    Sorted lists of probes meet runs' indexes in pairs of partitions; each interval of an index
    takes its stretch of a list by two binary searches, and the stretch is written out in place.
    The result has a row for each probe and run, since each run answers each probe, but none of
    them is shuffled, sorted or held: what is shuffled grows with probes and index entries, and
    a task holds one list and the indexes of its part of the runs, from 4096 runs on on disk. A get
    asks few keys, and whoever asks many cuts the runs by `key_ranges` first."""
    pairs = _chunks(probes).hint("shuffle_replicate_nl").join(_intervals(index).repartition(RUN_PARTS))
    pieces = pairs.select("run_id", "keys", F.explode(_stretches(F.col("intervals"), F.col("keys"))).alias("e"))
    stretch = F.when((F.col("e.start") == 0) & (F.col("e.end") == F.size("keys")), F.col("keys")).otherwise(F.slice("keys", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")))
    return pieces.select("run_id", F.explode(stretch).alias("key"), F.col("e.last_key").alias("found_key"), F.col("e.block_offset").alias("found_offset"))


def file_size(rows: DataFrame, index: DataFrame, fp: float = 0.01) -> DataFrame:
    """Blocks, filter (16 and its bits), index (16, 4 and 14 with the key for each block) and footer."""
    per_run = index.groupBy("run_id").agg(F.sum("block_size").alias("blocks_bytes"), F.count("*").alias("blocks"), F.sum(F.octet_length("last_key").cast("long") + 14).alias("keys_bytes"))
    filters = with_params(footer_stats(rows).select("run_id", F.col("entry_count").alias("n")), fp)
    return per_run.join(filters, "run_id").select(
        "run_id", (F.col("blocks_bytes") + 16 + F.expr("m div 8") + 16 + 4 * F.col("blocks") + F.col("keys_bytes") + FOOTER).cast("long").alias("size_bytes"))
