"""The mutation log as bytes: tag, varint lengths, key, value, CRC-32C of all before it."""

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidelog.functions import crc32c_many, varint_bytes, varint_decode_bytes

SET, DELETE = 1, 2
CHECKED = 1024


def encode_many(records: list[tuple[bytes, bytes | None]]) -> bytes:
    bodies = [bytes([DELETE if value is None else SET]) + varint_bytes(len(key)) + varint_bytes(len(value or b"")) + key + (value or b"") for key, value in records]
    return b"".join(body + struct.pack("<I", int(c)) for body, c in zip(bodies, crc32c_many(bodies)))


def encode(key: bytes, value: bytes | None) -> bytes:
    return encode_many([(key, value)])


def decode(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(offset, next offset, key, value); stops silently at the first torn or damaged record.

    Records are cut first, CHECKED at a time, and their checksums are computed together."""
    while at < len(data):
        cut = []
        while at < len(data) and len(cut) < CHECKED:
            try:
                tag = data[at]
                klen, p = varint_decode_bytes(data, at + 1)
                vlen, p = varint_decode_bytes(data, p)
            except ValueError:
                break
            end = p + klen + vlen
            if tag not in (SET, DELETE) or end + 4 > len(data):
                break
            cut.append((at, p, p + klen, end, tag))
            at = end + 4
        sums = crc32c_many([data[a:end] for a, _, _, end, _ in cut]) if cut else []
        for (a, p, q, end, tag), c in zip(cut, sums):
            if struct.unpack("<I", data[end : end + 4])[0] != int(c):
                return
            yield a, end + 4, data[p:q], data[q:end] if tag == SET else None
        if len(cut) < CHECKED:
            return


def read(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Log files as mutations with their offset; seq orders records within a file.

    A file is the unit of work since records can only be found from its start: keep files
    to a few MB, as the writers here do."""

    def rows(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                got = list(decode(bytes(content), start))
                yield pd.DataFrame({"file": [file] * len(got), "offset": [g[0] for g in got], "key": [g[2] for g in got], "value": [g[3] for g in got], "tomb": [g[3] is None for g in got]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, offset long, key binary, value binary, tomb boolean")
