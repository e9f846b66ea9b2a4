"""Fixed row shapes."""

from pyspark.sql import types as T

MAX_KEY_LEN = 4096

MUTATION = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("tomb", T.BooleanType(), False),
])

MANIFEST_ENTRY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("object_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("key_min", T.StringType()),
    T.StructField("key_max", T.StringType()),
    T.StructField("created_at_ms", T.LongType()),
])

MANIFEST = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("sstables", T.ArrayType(MANIFEST_ENTRY)),
    T.StructField("wal_committed_bytes", T.LongType()),
])
