"""Token ids as ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

A row is a segment of one document: its shard (the writing task), row number and start
within the shard, and at most SEGMENT ids, so that no row grows with a text. Shards hold
ascending ranges of document ids, in files of a bounded number of rows; readers split files
by stripes, and a filter on doc_id prunes files, stripes and row groups by statistics and Bloom filters.

Null and empty texts are documents of the end id alone; rows without an id come first;
rows with one id are ordered by a hash of their text, so equal rows stay apart and ties
don't matter; an empty table gives an empty file set; extra columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tidelog.llm.shared import Scratch, partitions, sliced, worker_cache
from tidelog.llm.tokens import encoder

END, SEGMENT = 0, 4096
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "orc.compress": "ZSTD", "maxRecordsPerFile": str(1 << 17)}


def schema(doc_id: T.DataType) -> T.StructType:
    f = T.StructField
    return T.StructType([f("doc_id", doc_id), f("shard", T.IntegerType()), f("row", T.LongType()), f("start", T.LongType()), f("seg", T.IntegerType()), f("segs", T.IntegerType()), f("n", T.IntegerType()), f("ids", T.ArrayType(T.IntegerType()))])


def write(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, shards: int | None = None) -> None:
    """Encodes whole texts and writes them in ascending order of their ids."""
    out = schema(df.schema[doc_id].dataType)
    tail = np.array([end], "<u4").tobytes()

    def work(batches):
        enc, shard = encoder(tokenizer, "byte"), TaskContext.get().partitionId()
        row = start = 0
        keys, cols, ids, held = [], [[] for _ in range(6)], [], 0

        def flush():
            nonlocal keys, cols, ids, held
            data = np.frombuffer(b"".join(ids), "<i4")
            offs = np.concatenate(([0], np.cumsum(cols[5]))).astype(np.int32)
            arrays = [pa.array(keys, key_type), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()), pa.ListArray.from_arrays(pa.array(offs), pa.array(data))]
            keys, cols, ids, held = [], [[] for _ in range(6)], [], 0
            return pa.RecordBatch.from_arrays(arrays, [f.name for f in out])

        for b in sliced(batches, 1):
            key_type = b.schema.types[0]
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                coded = enc.ids(t or "") + tail
                n = len(coded) // 4
                segs = -(-n // SEGMENT)
                for k in range(segs):
                    part = coded[4 * k * SEGMENT : 4 * (k + 1) * SEGMENT]
                    keys.append(key)
                    ids.append(part)
                    for c, v in zip(cols, (shard, row, start, k, segs, len(part) // 4)):
                        c.append(v)
                row, start, held = row + 1, start + n, held + n
                if held >= 1 << 20:
                    yield flush()
        if keys:
            yield flush()

    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    dealt = src.repartitionByRange(shards or partitions(df.sparkSession, 8), F.col("doc_id").asc_nulls_first(), digest)
    dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), digest).mapInArrow(work, out).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_id: T.DataType = T.LongType()) -> DataFrame:
    return spark.read.schema(schema(doc_id)).orc(path)


def crc_combine(a: int, b: int, n: int) -> int:
    """CRC-32 of a text of two parts from the parts' own, n being the second one's bytes.

    Appending zeros is linear in the register, so its matrix to each power of two is kept and used along n's bits."""
    cache, bits, k = worker_cache(), 8 * n, 0
    if "crc" not in cache:
        cache["crc"] = [[0xEDB88320] + [1 << j for j in range(31)]]  # the register after one zero bit
    powers = cache["crc"]

    def times(m, v):
        out = j = 0
        while v:
            if v & 1:
                out ^= m[j]
            v, j = v >> 1, j + 1
        return out

    while bits:
        if k == len(powers):
            powers.append([times(powers[-1], x) for x in powers[-1]])
        if bits & 1:
            a = times(powers[k], a)
        bits, k = bits >> 1, k + 1
    return a ^ b


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    spark = files.sparkSession
    key = files.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "tokens")

    def sums(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            offs = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy()).astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(7)), pa.array(crc, pa.int64())], [*b.schema.names[:7], "crc"])

    seen = scratch.keep(files.mapInArrow(sums, f"doc_id {key}, shard int, row long, start long, seg int, segs int, n int, crc long"), "segments")

    @F.pandas_udf(T.LongType())
    def joined(n, crc):
        import pandas as pd

        out = []
        for ns, cs in zip(n, crc):
            c = int(cs[0])
            for k in range(1, len(cs)):
                c = crc_combine(c, int(cs[k]), 4 * int(ns[k]))
            out.append(c)
        return pd.Series(out, dtype="int64")

    many = seen.where("segs > 1").groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seg", "n", "crc"))).alias("x"))
    cols = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
    docs = seen.where("segs = 1").select("shard", "doc_id", "start", F.col("n").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32")).union(many.withColumn("ids_crc32", joined("x.n", "x.crc")).select(*cols))
    # One row for each writing task, so this side never grows with the documents.
    total = seen.groupBy("shard").agg(F.sum("n").alias("size"))
    base = total.select(F.col("shard").alias("of"), F.coalesce(F.sum("size").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(base), F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op1(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "orc")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("tokens"))
    out = scratch.keep(digests(read(spark, scratch.path("tokens"))), "digests")
    scratch.drop("tokens")
    return out
