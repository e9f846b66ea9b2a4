"""Index blocks and data blocks, whole and damaged."""

import struct

import pytest
from pyspark.sql import functions as F

from tidelog.sources import blocks


def block(entries, magic=blocks.MAGIC, version=1, flags=0, grow=0):
    heap, places = b"", []
    for key, offset, size, length in entries:
        places.append(len(heap))
        heap += struct.pack("<QIH", offset, size, length) + key
    return struct.pack("<IHHII", magic, version, flags, len(entries), len(heap) + grow) + struct.pack(f"<{len(places)}I", *places) + heap


GOOD = [(b"a", 0, 10, 1), ("é".encode(), 2**40, 2**32 - 1, 2), (b"z" * 4096, 7, 8, 4096)]


@pytest.mark.parametrize("data, error", [
    (None, "BufferTooSmall"), (b"", "BufferTooSmall"), (block(GOOD)[:15], "BufferTooSmall"), (block(GOOD)[:-1], "BufferTooSmall"), (block(GOOD, grow=1), "BufferTooSmall"),
    (block(GOOD, magic=1), "BadMagic"), (block(GOOD, version=2), "UnsupportedVersion"), (block(GOOD, flags=1), "BadFlags"),
    (struct.pack("<IHHII", blocks.MAGIC, 1, 0, 2**32 - 1, 2**32 - 1), "BufferTooSmall")])
def test_bad_blocks(spark, data, error):
    got = spark.createDataFrame([(data,)], "b binary").select(blocks.parsed_index(F.col("b")).alias("p")).first().p
    assert (got.error, got.entries) == (error, None)


def test_entries(spark):
    bad = [(b"a", 0, 1, 4097), (b"b", 5, 6, 1), (b"c", 0, 1, 9)]
    stomped = bytearray(block(GOOD))
    stomped[16:20] = b"\xff" * 4
    df = spark.createDataFrame([(1, bytearray(block(GOOD))), (2, bytearray(block(bad))), (3, stomped), (4, bytearray(block([])))], "k int, b binary")
    got = {r.k: r.p for r in df.select("k", blocks.parsed_index(F.col("b")).alias("p")).collect()}
    assert [(e.error, e.key, e.block_offset, e.block_size) for e in got[1].entries] == [(None, k.decode(), o, s) for k, o, s, _ in GOOD]
    assert [(e.error, e.key) for e in got[2].entries] == [("KeyTooLong", None), (None, "b"), ("KeyOutOfRange", None)]
    assert [e.error for e in got[3].entries] == ["OffsetOutOfRange", None, None]
    assert got[4].error is None and got[4].entries == []


def test_round_trip(spark):
    index = spark.createDataFrame([(r, f"k{k:03d}", 100 + k, 1000 * k) for r in (1, 2) for k in range(50)], "run_id long, last_key string, block_size long, block_offset long")
    back = blocks.index_blocks(index).select("run_id", F.explode(blocks.parsed_index(F.col("block"))["entries"]).alias("e")).select("run_id", "e.key", "e.block_size", "e.block_offset")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.collect()))


def test_checksums(spark):
    df = spark.createDataFrame([(1, b"123456789" + struct.pack("<I", 0xE3069283)), (2, b"123456780" + struct.pack("<I", 0xE3069283)), (3, b"\0" * 4), (4, b"abc"), (5, None)], "k int, b binary")
    got = {r.k: (r.c.error, r.c.payload) for r in df.select("k", blocks.checked(F.col("b")).alias("c")).collect()}
    bad = ("BadDataBlock", None)
    assert got == {1: (None, b"123456789"), 2: bad, 3: (None, b""), 4: bad, 5: bad}
