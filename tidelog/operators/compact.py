"""Merging runs."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.operators.log import last_per


def merge(runs: DataFrame, drop_tombstones: bool = False, full: bool = True) -> DataFrame:
    """Newest run wins for each key. Dropping tombstones is legal only when no older run stays out."""
    if drop_tombstones and not full:
        raise ValueError("tombstones of a partial merge still hide older runs")
    merged = last_per(runs.select("key", "run_id", "seq", "value", "tomb"), "key")
    return merged.where(~F.col("tomb")) if drop_tombstones else merged


def merge_frames(frames: list[DataFrame]) -> DataFrame:
    """Frames from newest to oldest; on equal keys the earlier frame wins."""
    ranked = [f.select("key", "value", "tomb", F.lit(-k).cast("long").alias("seq")) for k, f in enumerate(frames)]
    return last_per(reduce(DataFrame.unionByName, ranked), "key").drop("seq")


def partial(runs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Runs lo to hi become one run named hi; tombstones stay."""
    inside = F.col("run_id").between(lo, hi)
    cols = ["run_id", "key", "seq", "value", "tomb"]
    return merge(runs.where(inside)).withColumn("run_id", F.lit(hi).cast("long")).select(*cols).unionByName(runs.where(~inside).select(*cols))


def shadowed(runs: DataFrame) -> DataFrame:
    """Rows of each run that a newer run hides: a max for each key, joined back."""
    top = runs.groupBy("key").agg(F.max("run_id").alias("top"))
    return runs.join(top, "key").groupBy("run_id").agg(F.count(F.when(F.col("run_id") < F.col("top"), 1)).alias("shadowed"), F.count("*").alias("entries"))


def trigger_schedule(spark: SparkSession, flushes: int, threshold: int) -> DataFrame:
    """Which flush starts a merge: runs grow by one with each flush and fall to one with a merge."""
    i = F.col("flush_no")
    fires = (i >= threshold) & ((i - threshold) % (threshold - 1) == 0) if threshold >= 2 else (i >= 2 if threshold == 1 else F.lit(False))
    left = F.when(fires, 1).when(i < threshold, i).otherwise((i - threshold) % (threshold - 1) + 1) if threshold >= 2 else i
    return spark.range(1, flushes + 1).select(F.col("id").alias("flush_no")).select(i, fires.alias("merges"), left.cast("long").alias("runs_after"))


def key_range(runs: DataFrame) -> DataFrame:
    return runs.agg(F.min("key").alias("key_min"), F.max("key").alias("key_max"))


def orphans(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select("object_path"), "object_path", "left_anti")
