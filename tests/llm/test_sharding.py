import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import queries, sharding

NAMES = [f"n{k}" for k in range(7)]


def brute_fill(names, slots):
    orders = []
    for s in names:
        a, b = (int.from_bytes(hashlib.md5(f"{x}/{s}".encode()).digest()[:8], "big") for x in ("offset", "stride"))
        orders.append([(a + j * (b % (slots - 1) + 1)) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for k, order in enumerate(orders):
            free = [p for p in order if p not in table]
            if free:
                table[free[0]] = k
    return [table[p] for p in range(slots)]


def test_fill_is_even_and_steady():
    assert sharding.fill(NAMES, 101) == brute_fill(NAMES, 101)
    table = sharding.fill(NAMES, 10_007)
    n = Counter(table)
    assert max(n.values()) - min(n.values()) <= 1
    fewer = sharding.fill(NAMES[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.1 * 10_007
    with pytest.raises(ValueError):
        sharding.fill(NAMES, 100)


def test_placement(spark, frame):
    df = frame([(1, "a"), (1, "a"), (2, None), (None, ""), (None, "x")]).withColumn("slot", F.lit("old"))
    got = sharding.place(df, F.col("doc_id"), NAMES, 101, slot_to="place").collect()
    table = sharding.fill(NAMES, 101)
    assert len(got) == 5
    for r in got:
        key = "\0null" if r.doc_id is None else str(r.doc_id)
        p = int(hashlib.md5(key.encode()).hexdigest()[:12], 16) % 101
        assert (r.place, r.shard, r.slot) == (p, table[p], "old")
    kept = sharding.place(df.withColumn("Shard", F.lit("mine")).withColumn("_placed_at", F.lit(1)), F.col("doc_id"), NAMES, 101)
    assert kept.columns == [*df.columns, "Shard", "_placed_at", "_slot", "_shard"] and {(r.slot, r.Shard) for r in kept.collect()} == {("old", "mine")}
    assert sharding.place(frame([]), F.col("doc_id"), NAMES, 101).count() == 0


def test_whole_table(spark, sf):
    df = sharding.op10(spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_write(spark, frame, tmp_path):
    sharding.write_sharded(frame([(k, "t") for k in range(50)]), F.col("doc_id"), NAMES, str(tmp_path / "o"), 101)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 50
