"""Reads: the live view, lookups and what they cost."""

from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.operators.log import last_per, with_segment


def newest(log: DataFrame) -> DataFrame:
    return last_per(log.select("key", "seq", "value", "tomb"), "key")


def live(log: DataFrame) -> DataFrame:
    """Last writer wins; deleted keys are gone."""
    return newest(log).where(~F.col("tomb")).select("key", "value", "seq")


def point_get(log: DataFrame, key: str) -> DataFrame:
    """The filter comes before the aggregation. It reaches the files where the log holds the key as a column, as runs do."""
    return live(log.where(F.col("key") == key))


def lookup(log: DataFrame, probes: DataFrame) -> DataFrame:
    """present, tombstone or absent for every probe. The log is cut to the probed keys by a
    semi join before it is aggregated; Spark broadcasts the probes only when they are small."""
    wanted = probes.select("key").distinct()
    hit = newest(log.join(wanted, "key", "left_semi"))
    state = F.when(F.col("tomb").isNull(), "absent").when(F.col("tomb"), "tombstone").otherwise("present")
    return probes.join(hit, "key", "left").select("key", state.alias("state"), F.when(~F.col("tomb"), F.col("value")).alias("value"))


def missing(log: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(live(log).select("key"), "key", "left_anti").select("key")


def resurrected(log: DataFrame) -> DataFrame:
    """Sets that directly follow a deletion of their key."""
    prev = F.lag("tomb").over(W.partitionBy("key").orderBy("seq"))
    return log.withColumn("was", prev).where(F.col("was") & ~F.col("tomb")).select("key", "seq", "value")


def read_tier(log: DataFrame) -> DataFrame:
    """Where a get of each live or deleted key ends: the newest segment is active, the one before frozen."""
    top = with_segment(log).agg(F.max("segment").alias("top"))
    hit = with_segment(log).groupBy("key").agg(F.max("segment").alias("segment"))
    tier = F.when(F.col("segment") == F.col("top"), "active").when(F.col("segment") == F.col("top") - 1, "frozen").otherwise("run")
    return hit.join(F.broadcast(top)).select("key", "segment", tier.alias("tier"))


def read_amplification(log: DataFrame) -> DataFrame:
    """Segments that a get looks into before its hit: all newer ones, or those whose key range covers it.

    The ranges are one row for each segment, as in a manifest, and go to the keys as one list."""
    seg = with_segment(log)
    ranges = seg.groupBy("segment").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    hit = seg.groupBy("key").agg(F.max("segment").alias("hit"))
    held = ranges.agg(F.array_sort(F.collect_list(F.struct("segment", "lo", "hi"))).alias("all"))
    newer = F.filter("all", lambda r: r["segment"] > F.col("hit"))
    return hit.join(F.broadcast(held)).select(
        "key", "hit", F.size(newer).cast("long").alias("newer"),
        F.size(F.filter(newer, lambda r: F.col("key").between(r["lo"], r["hi"]))).cast("long").alias("newer_in_range"))


def range_scan(log: DataFrame, lo: str, hi: str) -> DataFrame:
    return live(log.where(F.col("key").between(lo, hi)))


def stats(log: DataFrame) -> DataFrame:
    seg = with_segment(log)
    top = seg.agg(F.max("segment").alias("top"))
    return seg.join(F.broadcast(top)).agg(
        F.count_distinct(F.when(F.col("segment") < F.col("top"), F.col("segment"))).alias("sstables"),
        F.count_distinct(F.when(F.col("segment") == F.col("top"), F.col("key"))).alias("active_entries"),
        F.lit(0).cast("long").alias("compaction_failures"),
    )
