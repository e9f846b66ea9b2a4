"""Blocks as bytes: data blocks with a checksum behind them, and index blocks that name data blocks.

An index block is a header (magic, version, flags, entries, bytes of the heap), the entries'
places in the heap in key order, and the heap (block offset, block size, key length, key).
Numbers are little-endian. Nothing that is read is trusted: what is wrong comes back as a
name in the column `error`, and one bad entry leaves the others readable."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.functions import crc32c, pack_le, unpack_le
from tidelog.schema import MAX_KEY_LEN

# Fixed values of the format.
MAGIC, VERSION, HEADER, ENTRY, CHECKSUM = 0x5844495A, 1, 16, 14, 4


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, whatever its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(block: Column, at: Column | int, width: int) -> Column:
    """The number at a place of a block; null where it ends beyond the block or above a long."""

    def read(digits):
        low = unpack_le(F.substring(digits, 1, 2 * min(width, 7)), min(width, 7))
        if width == 8:
            low = bound(unpack_le(F.substring(digits, 15, 2), 1), lambda top: F.when(top < 128, low + F.call_function("shiftleft", top, F.lit(56))))
        return F.when(F.length(digits) == 2 * width, low)

    first = F.least(F.lit(2**31 - 1).cast("long"), at + F.lit(1).cast("long"))
    return bound(F.hex(F.substring(block, first, F.lit(width))), read)


def with_checksum(payload: Column) -> Column:
    return F.concat(payload, F.unhex(pack_le(crc32c(payload), CHECKSUM)))


def checked(block: Column) -> Column:
    """(error, payload) of a data block; the payload is null where the checksum is not its own."""
    size = F.octet_length(block) - CHECKSUM
    payload = F.substring(block, F.lit(1), F.greatest(size, F.lit(0)))
    good = F.coalesce((size >= 0) & (crc32c(payload) == number(block, size, CHECKSUM)), F.lit(False))
    return F.struct(F.when(~good, "BadDataBlock").alias("error"), F.when(good, payload).alias("payload"))


def index_blocks(index: DataFrame) -> DataFrame:
    """(run_id, block): the sparse index of each run as one block."""
    size = (F.lit(ENTRY) + F.octet_length("last_key")).cast("long")
    before = W.partitionBy("run_id").orderBy("last_key").rowsBetween(W.unboundedPreceding, -1)
    placed = index.select(
        "run_id", "last_key", size.alias("size"), F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")).alias("at"),
        F.concat(pack_le(F.col("block_offset"), 8), pack_le(F.col("block_size"), 4), pack_le(F.octet_length("last_key"), 2), F.hex(F.col("last_key").cast("binary"))).alias("entry"))
    whole = placed.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "entry"))).alias("e"), F.count("*").alias("n"), F.sum("size").alias("heap"))
    header = F.concat(pack_le(F.lit(MAGIC), 4), pack_le(F.lit(VERSION), 2), pack_le(F.lit(0), 2), pack_le(F.col("n"), 4), pack_le(F.col("heap"), 4))
    places = F.array_join(F.transform("e.at", lambda x: pack_le(x, 4)), "")
    return whole.select("run_id", F.unhex(F.concat(header, places, F.array_join("e.entry", ""))).alias("block"))


def parsed_index(block: Column) -> Column:
    """(error, entries) of an index block; entries are (error, key, block_offset, block_size) in key order."""

    def parse(h):
        b, n, heap, size = h["b"], h["n"], h["heap"], F.octet_length(h["b"])
        start = HEADER + 4 * n
        error = (
            F.when(b.isNull() | (size < HEADER), "BufferTooSmall").when(number(b, 0, 4) != MAGIC, "BadMagic")
            .when(number(b, 4, 2) != VERSION, "UnsupportedVersion").when(number(b, 6, 2) != 0, "BadFlags").when(size < start + heap, "BufferTooSmall"))

        def entry(x):
            at, length = x["at"], x["length"]
            wrong = F.when(at + ENTRY > heap, "OffsetOutOfRange").when(length > MAX_KEY_LEN, "KeyTooLong").when(at + ENTRY + length > heap, "KeyOutOfRange")

            def out(e):
                fine = lambda c: F.when(e["wrong"].isNull(), c)
                key = F.substring(b, start + at + ENTRY + 1, length).cast("string")
                return F.struct(e["wrong"].alias("error"), fine(key).alias("key"), fine(number(b, start + at, 8)).alias("block_offset"), fine(number(b, start + at + 8, 4)).alias("block_size"))

            return bound(F.struct(wrong.alias("wrong")), out)

        placed = lambda i: bound(number(b, HEADER + 4 * i, 4), lambda at: F.struct(at.alias("at"), number(b, start + at + 12, 2).alias("length")))
        entries = F.transform(F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n), placed), entry)
        return bound(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), entries).alias("entries")))

    return bound(F.struct(block.alias("b"), number(block, 8, 4).alias("n"), number(block, 12, 4).alias("heap")), parse)
