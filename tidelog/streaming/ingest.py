"""Log ingestion as a stream: each micro-batch is one memtable and becomes one run."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidelog.operators import view
from tidelog.operators.log import last_per

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, one in the warehouse on a
    cluster and a temporary one in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named or f"file://{tempfile.mkdtemp(prefix='tidelog-')}"


def ingest(spark: SparkSession, sf_dir: str, out: str, max_files: int = 1, pattern: str = "events*.parquet") -> str:
    """Reads event files as a stream and writes runs to out, one for each micro-batch of so many
    files. A replayed batch overwrites its own run, and a call with the same folder goes on after the last one."""
    tomb = F.col("event_type") == "error"
    log = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(sf_dir).select(
        F.col("event_id").alias("seq"), F.format_string("u/%06d", "user_id").alias("key"), F.when(~tomb, F.col("props")).alias("value"), tomb.alias("tomb"))

    def flush(batch: DataFrame, batch_id: int) -> None:
        last_per(batch, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{out}/runs/run_id={batch_id}")

    query = log.writeStream.foreachBatch(flush).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{out}/runs"


def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    runs = ingest(spark, sf_dir, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    return view.live(spark.read.parquet(runs))
