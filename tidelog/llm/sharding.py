"""Shard placement by a lookup table that the shards fill in turns. Column expressions only.

Every shard has its own order over the slots of a prime-sized table: it starts at an
offset and goes on by a stride, both from hashes of its name. The shards claim their next
free slot one after another until the table is full, so shares differ by one slot at most,
and a shard that joins or leaves moves little besides its own share.

Null keys are one key of their own; equal keys, repeated rows and ties go to the same
slot; text length and empty texts don't matter; an empty table gives an empty result;
extra columns pass through under the caller's names; where one has the name of an added one,
in whatever case, the added one gets underscores in front.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.llm.shared import free_name

SLOTS = 65_537
SHARDS = 64
_NULL = "\0null"


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. The size is fixed by the parameters, not by the data."""
    if not is_prime(slots) or not shards or len(shards) > min(slots, 65_535) or len(set(shards)) < len(shards):
        raise ValueError("wanted: a prime number of slots, and distinct shards, no more than slots or 65,535")
    part = lambda name, salt: int.from_bytes(hashlib.md5(f"{salt}/{name}".encode()).digest()[:8], "big")
    at = [part(s, "offset") % slots for s in shards]
    stride = [part(s, "stride") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            p = at[k]
            while table[p] >= 0:
                p = (p + stride[k]) % slots
            table[p], at[k] = k, (p + stride[k]) % slots
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: 48 bits of its md5, modulo the table's size."""
    k = F.coalesce(key.cast("string"), F.lit(_NULL))
    return F.pmod(F.conv(F.substring(F.md5(k.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(slots))


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): two bytes a slot, unpacked by expressions."""
    packed = F.lit(bytearray(b"".join(s.to_bytes(2, "big") for s in fill(shards, slots))))
    at = (F.col("id") * 2 + 1).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), F.conv(F.hex(F.substring(packed, at, F.lit(2))), 16, 10).cast("int").alias("shard"))


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, slot_to: str = "slot", shard_to: str = "shard") -> DataFrame:
    """Adds slot and shard. The broadcast side has exactly `slots` rows, whatever the data."""
    slot_to, shard_to, at, of = (free_name(df, x) for x in (slot_to, shard_to, "_placed_at", "_placed_of"))
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(of), F.col("shard").alias(shard_to))
    keyed = df.withColumn(at, slot_of(key, slots)).join(F.broadcast(table), F.col(at) == F.col(of))
    return keyed.select(*[F.col(f"`{c}`") for c in df.columns], F.col(at).alias(slot_to), F.col(shard_to))


def write_sharded(df: DataFrame, key: Column, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """One folder for each shard. Rows are dealt by slot, of which a shard has many, so that no task gets a whole shard."""
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    place(df, key, shards, slots).repartition(slot).write.partitionBy(shard).parquet(path)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(docs, F.col("doc_id"), [f"shard-{k:04d}" for k in range(SHARDS)])
