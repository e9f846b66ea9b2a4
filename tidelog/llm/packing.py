"""Best-fit packing in rounds: partitions pack what they have, nearly full bins leave, and the
rest are packed again as items in fewer, larger mixtures until one partition has them all.

Null and empty texts are documents of the end id alone; only documents above the capacity
are cut; a document of any length is encoded whole; ties are ordered by content, so
rounds repeat alike; repeated rows and repeated or missing ids are pieces of their own;
an empty table gives an empty result; extra columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.shared import Scratch, sliced
from tidelog.llm.tokens import encoder

CAPACITY, END = 4096, 1
#: Items that one task packs. A bin is nearly full from this share of the capacity on.
ITEMS, NEARLY = 60_000, 0.995


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document."""
    key = df.schema[doc_id].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()

    def work(batches):
        enc = encoder(tokenizer, "word")
        for b in sliced(batches, 1):
            cols = [[] for _ in range(5)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                coded = memoryview(enc.ids(t or "") + tail)
                for p, at in enumerate(range(0, len(coded) // 4, capacity)):
                    part = coded[4 * at : 4 * (at + capacity)]
                    for c, v in zip(cols, (k, p, at, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            types = [b.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, f"doc_id {key}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by falling size, each into the bin with the least room that takes it.

    Bins wait in a list for each room; a bit mask of the rooms in use finds the smallest
    that is large enough."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for item, size in enumerate(sizes):
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used ^= 1 << room
            bins[b].append(item)
            room -= size
        else:
            b, room = len(bins), capacity - size
            bins.append([item])
        by_room[room].append(b)
        used |= 1 << room
    return bins


def _round(items: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """Bins of (total, members), packed within partitions. Items are dealt in turn, after a sort
    of each partition, so equal runs deal alike and no kind of item gathers in one task."""

    def work(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        total = t["total"].to_numpy()
        lists = t["members"].chunk(0) if t["members"].num_chunks else t["members"].combine_chunks()
        offs, flat = lists.offsets.to_numpy(), lists.values
        first = [flat.field(n).take(pa.array(offs[:-1])).to_numpy(zero_copy_only=False) for n in ("ids_crc32", "start")]
        order = np.lexsort((first[1], first[0], t["tie"].to_numpy(), -total))
        bins = best_fit(total[order].tolist(), capacity)
        part = TaskContext.get().partitionId()
        counts = offs[1:] - offs[:-1]
        for at in range(0, len(bins), 20_000):
            some = bins[at : at + 20_000]
            rows = order[np.concatenate([np.array(b) for b in some])]
            per_bin = np.array([len(b) for b in some])
            n = counts[rows]
            index = np.repeat(offs[:-1][rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            edges = np.concatenate(([0], np.cumsum(per_bin)))
            ends = np.concatenate(([0], np.cumsum(n)))[edges]
            sums = np.add.reduceat(total[rows], edges[:-1])
            ids = (number << 48) + (part << 28) + np.arange(at, at + len(some))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.take(pa.array(index)))], ["bin", "total", "members"])

    kind = items.schema["members"].dataType.simpleString()
    tied = items.withColumn("tie", F.xxhash64("members"))
    return tied.repartition(parts).select("total", "members", "tie").mapInArrow(work, f"bin long, total long, members {kind}")


def pack(parts: DataFrame, scratch: Scratch, capacity: int = CAPACITY, per_task: int = ITEMS) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Rounds end when one partition has packed all that was left, or when a round joins
    nothing more; every bin stays a sequence either way, so nothing is lost."""
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    items = parts.select(F.col("length").alias("total"), F.array(member).alias("members"))
    done, number, n = [], 0, parts.count()
    while True:
        tasks = max(1, -(-n // per_task))
        bins = scratch.keep(_round(items, number, tasks, capacity), f"bins-{number}")
        under = bins.where(F.col("total") < int(capacity * NEARLY))
        left = under.count()
        last = tasks == 1 or bins.count() == n
        done.append(bins if last else bins.where(F.col("total") >= int(capacity * NEARLY)))
        if last:
            break
        items, number, n = under.select("total", "members"), number + 1, left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    key = parts.schema["doc_id"].dataType.simpleString()
    return out.select("bin", "members").mapInArrow(_offsets, f"doc_id {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _offsets(batches):
    """Members of bins as rows, each at the end of those before it."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for b in batches:
        lists = b.column(1)
        edges = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        edges -= edges[0]
        n = edges[1:] - edges[:-1]
        length = flat.field("length").to_numpy()
        total = np.concatenate(([0], np.cumsum(length)))
        cols = [flat.field(x) for x in names]
        yield pa.RecordBatch.from_arrays([*cols, b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(total[:-1] - np.repeat(total[edges[:-1]], n), pa.int64())], [*names, "sequence_id", "offset"])


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, per_task: int = ITEMS) -> DataFrame:
    scratch = Scratch(df.sparkSession, "packing")
    return pack(scratch.keep(pieces(df, doc_id, text, tokenizer, capacity=capacity), "pieces"), scratch, capacity, per_task)


def op8(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
