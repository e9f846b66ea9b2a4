"""Scratch tables in the cluster's shared folder, and small helpers for Arrow workers."""

import atexit
import gc
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a folder in the warehouse on
    a cluster and a temporary one in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tidelog-llm-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


class Scratch:
    """Tables of one job. A written table cuts the lineage: what was lost is read again, not computed again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads, and lets Spark clean the shuffles behind them."""
        for n in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def worker_cache() -> dict:
    """A dict that outlives a task: workers are reused and by-value modules are not."""
    if not hasattr(sys, "_tidelog_cache"):
        sys._tidelog_cache = {}
    return sys._tidelog_cache


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    column = column.cast(pa.large_binary()) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().cast(pa.large_binary())
    return [b"" if v is None else v for v in column.to_pylist()]


def sliced(batches, column: int, most: int = 4 << 20):
    """Batches cut after about `most` bytes of a text column, which bounds what a worker makes of one.

    A longer text comes by itself, whole."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, z - a)
            a = z


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of length n + 1) of an Arrow string column; null is empty."""
    col = column.fill_null("") if column.null_count else column
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if col.buffers()[2] is not None and len(col) else np.zeros(0, np.uint8)
    return data, offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = "_" + wish
    return wish
