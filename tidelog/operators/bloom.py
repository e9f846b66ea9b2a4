"""Membership filters as relations: one row for each set bit."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.functions import hash_slices

LN2 = math.log(2)
UNROLLED = 8
SIDE_BY_SIDE, BLOCK_BITS = 1024, 1 << 24  # filters in one block, and about the bits of a block
BLOCK_PARTS = 4  # partitions of blocks that each partition of probes meets


def with_params(df: DataFrame, fp: float = 0.01) -> DataFrame:
    """Adds the bits m and probes k that n keys need for the wished rate of false positives."""
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    m = (8 * F.greatest(F.lit(1.0), F.ceil(-(n * F.log(F.lit(fp))) / F.lit(LN2 * LN2) / 8).cast("double"))).cast("long")
    k = F.least(F.lit(32), F.greatest(F.lit(1), F.ceil(F.col("m") / n * F.lit(LN2)))).cast("long")
    return df.withColumn("m", m).withColumn("k", k)


def _bits(df: DataFrame) -> DataFrame:
    h1, h2 = hash_slices(F.col("key"))
    return df.withColumn("h1", h1).withColumn("h2", h2).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumn("bit", F.pmod(F.col("h1") + F.col("i") * F.col("h2"), F.col("m"))).drop("h1", "h2", "i")


def build(rows: DataFrame, fp: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(parameters of each run, its set bits)."""
    params = with_params(rows.groupBy("run_id").agg(F.count("*").alias("n")), fp)
    bits = _bits(rows.select("run_id", "key").join(params, "run_id")).select("run_id", "bit").distinct()
    return params, bits


def packed(params: DataFrame, bits: DataFrame) -> DataFrame:
    """One row for each run with its filter as an array of longs that hold 32 bits each."""
    every = params.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(m - 1) div 32"))).alias("w"), F.lit(0).cast("long").alias("x"))
    words = bits.select("run_id", F.expr("bit div 32").alias("w"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("x")).union(every).groupBy("run_id", "w").agg(F.bit_or("x").alias("x"))
    return params.join(words.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("w", "x"))).getField("x").alias("words")), "run_id")


def spread(probes: DataFrame) -> DataFrame:
    """The probes' distinct keys over all shuffle partitions, however few bytes they are: what
    follows makes a row of each for every run, and adaptive execution would put them into one task.

    Dealt out after they are distinct and not by key: Spark drops a repartition below an aggregation or by
    what it is dealt out by already."""
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return probes.select("key").distinct().repartition(n)


def _asked(params: DataFrame, bits: DataFrame, probes: DataFrame) -> DataFrame:
    """(run_id, key, candidate): does the filter of each probe's run let it pass.

    A run's filter is read as a whole and a probe stops at its first bit that isn't set. The
    first UNROLLED bits are plain expressions, which compile; a list is walked only beyond them."""
    h1, h2 = hash_slices(F.col("key"))
    filters = packed(params, bits).select(F.col("run_id").alias("of"), "m", "k", "words")
    at = lambda i: (F.col("h1") + i * F.col("h2")) % F.col("m")
    set_ = lambda i: F.call_function("shiftright", F.get("words", F.shiftright(at(i), 5).cast("int")), at(i).bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1)) == 1
    all_set = F.lit(True)
    for i in range(UNROLLED):
        all_set = all_set & ((F.col("k") <= i) | set_(F.lit(i).cast("long")))
    rest = F.forall(F.sequence(F.lit(UNROLLED).cast("long"), F.col("k") - 1), set_)
    hashed = probes.withColumn("h1", h1).withColumn("h2", h2)
    if "run_id" in probes.columns:
        both = hashed.join(filters, F.col("run_id") == F.col("of"))
    else:  # in blocks of partitions: neither probes nor filters have a bound, so neither is broadcast
        both = filters.hint("shuffle_replicate_nl").join(hashed).withColumn("run_id", F.col("of"))
    return both.select("run_id", "key", (all_set & ((F.col("k") <= UNROLLED) | rest)).alias("candidate"))


def probe(params: DataFrame, bits: DataFrame, rows: DataFrame, probes: DataFrame) -> DataFrame:
    """For every run and probe: does the filter let it pass, and is the key there.

    The result has a row for each probe and run, since each run answers each probe."""
    there = rows.select("run_id", "key").distinct().withColumn("there", F.lit(True))
    return _asked(params, bits, spread(probes)).join(there, ["run_id", "key"], "left").select("run_id", "key", "candidate", F.coalesce("there", F.lit(False)).alias("present"))


def turned(words: np.ndarray, m: int) -> np.ndarray:
    """Filters of one size, a row of 32-bit words each, as a row for each bit with a bit for each filter.

    Rows are padded to whole machine words of 1, 2, 4 or 8 bytes."""
    bits = np.unpackbits(np.ascontiguousarray(words, "<u4").view(np.uint8), axis=1, bitorder="little")[:, :m]
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    width = rows.shape[1]
    wide = next((w for w in (1, 2, 4) if width <= w), -(-width // 8) * 8)
    return np.pad(rows, ((0, 0), (0, wide - width)))


def column_sums(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set over all rows of words: halves are added as binary numbers, one word for all of its bits at a time."""
    planes = [rows]
    while len(planes[0]) > 16:
        half = -(-len(planes[0]) // 2)
        lo, hi = [p[:half] for p in planes], [np.pad(p[half:], ((0, 2 * half - len(p)), (0, 0))) for p in planes]
        carry, planes = np.zeros_like(lo[0]), []
        for x, y in zip(lo, hi):
            odd = x ^ y
            planes.append(odd ^ carry)
            carry = (x & y) | (odd & carry)
        planes.append(carry)
    return sum(np.unpackbits(np.ascontiguousarray(p).view(np.uint8), axis=1, bitorder="little").sum(0, np.int64) << i for i, p in enumerate(planes))


def passing(rows: np.ndarray, k: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """How many of the hashed keys each filter of a block lets pass."""
    m, width = rows.shape
    words = np.ascontiguousarray(rows).view({1: "u1", 2: "u2", 4: "u4"}.get(width, "u8"))
    at, step = h1 % m, h2 % m
    held = words.take(at, axis=0)
    for _ in range(k - 1):
        at += step
        at -= m * (at >= m)
        held &= words.take(at, axis=0)
    return column_sums(held)


def _blocks(params: DataFrame, bits: DataFrame) -> DataFrame:
    """Filters of one size side by side, at most SIDE_BY_SIDE in a block."""

    def turn(batches):
        for batch in batches:
            for m, k, held in zip(batch["m"], batch["k"], batch["held"]):
                run, words = held.values.flatten()
                rows = turned(words.flatten().to_numpy().reshape(len(run), -1), m.as_py())
                yield pa.RecordBatch.from_pydict({"m": [m.as_py()], "k": [k.as_py()], "runs": [run.to_pylist()], "rows": [rows.tobytes()]})

    most = F.greatest(F.lit(8), F.least(F.lit(SIDE_BY_SIDE), F.expr(f"{BLOCK_BITS} div m")))
    place = F.row_number().over(W.partitionBy("m", "k").orderBy("run_id")) - 1
    placed = params.withColumn("most", most).withColumn("place", place).withColumn("block", F.expr("place div most")).drop("most", "place")
    held = packed(placed, bits).groupBy("m", "k", "block").agg(F.collect_list(F.struct("run_id", "words")).alias("held"))
    return held.select("m", "k", "held").mapInArrow(turn, "m long, k long, runs array<long>, rows binary")


def _passed(params: DataFrame, bits: DataFrame, keys: DataFrame) -> DataFrame:
    """(run_id, probes, candidates): how many keys each run's filter is asked for and lets pass.

    Keys are hashed once and come in lists of an Arrow batch; each list meets each block of
    filters in pairs of partitions, and a key's bit of all filters of a block is read at once.
    A task holds one batch of pairs and its part of the blocks, and only sums are shuffled."""
    h1, h2 = hash_slices(F.col("key"))

    def listed(batches):
        for batch in batches:
            known = batch.filter(batch["h1"].is_valid())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "h1": [known["h1"].to_numpy()], "h2": [known["h2"].to_numpy()]}, pa.schema([("n", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64()))]))

    def count(batches):
        for batch in batches:
            for n, a, b, m, k, runs, rows in zip(*(batch[c] for c in ("n", "h1", "h2", "m", "k", "runs", "rows"))):
                table = np.frombuffer(rows.as_buffer(), np.uint8).reshape(m.as_py(), -1)
                run = runs.values
                found = passing(table, k.as_py(), a.values.to_numpy(), b.values.to_numpy())[: len(run)]
                yield pa.RecordBatch.from_arrays([run, pa.array(np.full(len(run), n.as_py())), pa.array(found)], ["run_id", "probes", "candidates"])

    lists = keys.select(h1.alias("h1"), h2.alias("h2")).mapInArrow(listed, "n long, h1 array<long>, h2 array<long>")
    pairs = lists.hint("shuffle_replicate_nl").join(_blocks(params, bits).repartition(BLOCK_PARTS))
    each = pairs.mapInArrow(count, "run_id long, probes long, candidates long")
    return each.groupBy("run_id").agg(F.sum("probes").alias("probes"), F.sum("candidates").alias("candidates"))


def false_positives(params: DataFrame, bits: DataFrame, rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Per run what `probe` would count up to: probes, candidates, hits and false positives.

    Filters of one size are probed side by side, and no row of probe and run is made; hits come
    from the runs' own keys that are asked for."""
    keys = spread(probes)
    all_ = _passed(params, bits, keys)
    there = rows.select("run_id", "key").distinct().join(keys, "key", "left_semi")
    hits = _asked(params, bits, there).where("candidate").groupBy("run_id").agg(F.count("*").alias("hits"))
    found = F.coalesce("hits", F.lit(0).cast("long"))
    return all_.join(hits, "run_id", "left").select("run_id", "probes", "candidates", found.alias("hits"), (F.col("candidates") - found).alias("false_positives"))
