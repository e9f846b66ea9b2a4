"""Scalar functions: column expressions where Spark has the parts, Arrow-batched UDFs elsewhere."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

VARINT_STEPS = 10


def varint_size(n) -> Column:
    """Bytes that unsigned LEB128 takes for a non-negative long."""
    c = F.col(n) if isinstance(n, str) else n
    out = F.when(c < 128, 1)
    for k in range(2, 9):
        out = out.when(c < 1 << (7 * k), k)
    return out.otherwise(9).cast("long")


def varint_encode(n) -> Column:
    """Unsigned LEB128 of a non-negative long, as upper-case hex."""
    c = F.col(n) if isinstance(n, str) else n
    groups = F.transform(
        F.sequence(F.lit(1), varint_size(c).cast("int")),
        lambda k: F.lpad(
            F.hex(
                F.call_function("shiftright", c, ((k - 1) * 7).cast("int")).bitwiseAND(F.lit(127))
                + F.when(k < varint_size(c), 128).otherwise(0)
            ), 2, "0"),
    )
    return F.array_join(groups, "")


def varint_decode_bytes(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next offset); ValueError when cut off or longer than ten bytes."""
    value = 0
    for step in range(VARINT_STEPS):
        if at + step >= len(data):
            raise ValueError("truncated varint")
        byte = data[at + step]
        value |= (byte & 0x7F) << (7 * step)
        if byte < 0x80:
            if value >= 1 << 64:
                raise ValueError("varint overflow")
            return value, at + step + 1
    raise ValueError("varint overflow")


def varint_bytes(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 0x7F
        out.append(low | (0x80 if value else 0))
        if not value:
            return bytes(out)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value; works byte column by byte column over the whole batch."""
    table = _crc_table()
    lens = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-lens, kind="stable")
    sorted_lens, starts = lens[order], np.zeros(len(values), np.int64)
    starts[1:] = np.cumsum(lens)[:-1]
    starts = starts[order]
    flat = np.frombuffer(b"".join(values), np.uint8)
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    live = len(values)
    for pos in range(int(lens.max()) if len(values) else 0):
        live = int(np.searchsorted(-sorted_lens[:live], -pos, side="left"))
        b = flat[starts[:live] + pos]
        crc[:live] = table[(crc[:live] ^ b) & 0xFF] ^ (crc[:live] >> 8)
    out = np.empty(len(values), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C (Castagnoli) of binary or string values; null in, null out."""
    null = data.isna()
    raw = [b"" if n else (v.encode() if isinstance(v, str) else bytes(v)) for v, n in zip(data, null)]
    return pd.Series(crc32c_many(raw).astype("int64")).astype("Int64").mask(null.to_numpy())


def percent_decode(c: Column) -> Column:
    """%XX decoding that leaves '+' alone; malformed input gives null."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def percent_encode_path(c: Column) -> Column:
    """Unreserved characters and '/' stay; every other byte becomes %XX in upper case."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)


def parse_port(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when((n >= 0) & (n <= 65535) & c.rlike(r"^\+?[0-9]+$"), n)


def object_path(c: Column) -> Column:
    return F.format_string("sstables/%06d.sst", c)


def range_header(start: Column, length: Column) -> Column:
    return F.format_string("bytes=%d-%d", start, start + length - 1)


def parse_range(c: Column) -> Column:
    get = lambda k: F.regexp_extract(c, r"^bytes=([0-9]+)-([0-9]+)$", k).try_cast("long")
    return F.struct(get(1).alias("first"), get(2).alias("last"))


def hash_slices(c: Column) -> tuple[Column, Column]:
    """Two 48-bit hashes of a string, the same in every SQL engine that has md5."""
    part = lambda at: F.conv(F.substring(F.md5(c), at, 12), 16, 10).cast("long")
    return part(1), part(13)


def pack_le(n: Column, width: int) -> Column:
    """A non-negative whole number as so many little-endian bytes, in upper-case hex."""
    return F.concat(*[F.lpad(F.hex(F.call_function("shiftright", n.cast("long"), F.lit(8 * k)).bitwiseAND(F.lit(255))), 2, "0") for k in range(width)])


def unpack_le(digits: Column, width: int) -> Column:
    """The number that pack_le wrote, for widths up to seven."""
    return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]), 16, 10).cast("long")
