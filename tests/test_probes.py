"""The lookups of every id, against brute force."""

import bisect
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from tidelog.operators import bloom, runs as R

N = 2300


def events():
    return [(k, (k * 37) % 700 + (k % 5) * 300, "error" if k % 7 == 0 else "view", f'{{"k": {k % 100}}}') for k in range(N)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    df = spark.createDataFrame(events(), "event_id long, user_id long, event_type string, props string")
    df.selectExpr("event_id", "timestamp_ntz'2024-01-01' as ts", "user_id", "event_type", "cast(1 as double) as value", "props").write.parquet(f"{d}/events.parquet")
    return d


def name(k):
    return f"u/{k:06d}"


def newest(rows):
    return {name(u): (None if t == "error" else v, t == "error") for _, u, t, v in rows}


def runs():
    return {r: newest([x for x in events() if x[0] // 1000 == r]) for r in range(-(-N // 1000))}


def state(at, key):
    return ("absent", None) if key not in at else ("tombstone", None) if at[key][1] else ("present", at[key][0])


def test_lookups(spark, small):
    at, keys = newest(events()), [name(k) for k in range(N)]
    want = sorted((k, *state(at, k)) for k in keys)
    got = sorted((r.key, r.state, r.value) for r in e.queries()["kv_multi_get"](spark, small).collect())
    assert got == want
    assert {s for k, s, _ in want if k >= name(400)} == {"absent", "tombstone", "present"}
    count = {s: sum(x[1] == s for x in want) for s in ("absent", "tombstone", "present")}
    assert {r.state: r["keys"] for r in e.queries()["kv_lookup_state"](spark, small).collect()} == count
    assert sorted(r.key for r in e.queries()["kv_missing_keys"](spark, small).collect()) == [k for k, s, _ in want if s != "present"]


def test_lower_bound(spark, small):
    want = set()
    for r, rows in runs().items():
        index, used, at = [], 0, 0
        for key in sorted(rows):
            entry = 8 + len(key) + len(rows[key][0] or "")
            if used and used + entry > 512:
                index.append((last, at))
                at, used = at + used + 20, 0
            used, last = used + entry, key
        index.append((last, at))
        want |= {(r, name(k), *next((x for x in index if x[0] >= name(k)), (None, None))) for k in range(N)}
    got = [(r.run_id, r.key, r.found_key, r.found_offset) for r in e.queries()["run_index_lower_bound"](spark, small).collect()]
    assert len(got) == len(want) and set(got) == want


def test_filters(spark, small):
    def bits(key, m, k):
        h = hashlib.md5(key.encode()).hexdigest()
        return {(int(h[:12], 16) + i * int(h[12:24], 16)) % m for i in range(k)}

    want = set()
    for r, rows in runs().items():
        m = 8 * max(1, math.ceil(-len(rows) * math.log(0.01) / math.log(2) ** 2 / 8))
        k = min(32, max(1, math.ceil(m / len(rows) * math.log(2))))
        held = set().union(*(bits(x, m, k) for x in rows))
        passed = [x for x in map(name, range(N)) if bits(x, m, k) <= held]
        hits = sum(x in rows for x in passed)
        want.add((r, N, len(passed), hits, len(passed) - hits))
    got = {(r.run_id, r.probes, r.candidates, r.hits, r.false_positives) for r in e.queries()["bloom_probe"](spark, small).collect()}
    assert got == want
    rows, probes = e.catalogue._runs(spark, small), e.catalogue._probes(spark, small)
    each = [tuple(r) for r in bloom.probe(*bloom.build(rows), rows, probes).collect()]
    assert len(each) == len(runs()) * N and not [x for x in each if x[3] and not x[2]]
    assert {(r, sum(x[2] for x in each if x[0] == r), sum(x[3] for x in each if x[0] == r)) for r in runs()} == {(r, c, h) for r, _, c, h, _ in want}


def shuffled(df):
    """The rows of each shuffle of a query that has run, and the partitions that its last step has."""
    out, plan = [], df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        if name == "Exchange":
            out.append(p.metrics().apply("shuffleRecordsWritten").value())
    return out


def test_lower_bound_shuffles_no_row_of_probe_and_run(spark, small):
    df = e.queries()["run_index_lower_bound"](spark, small)
    assert len(df.collect()) == N * len(runs())
    assert max(shuffled(df)) <= N


def test_lower_bound_of_any_keys(spark):
    """Null and empty probes, runs of one block, and lists and indexes longer than a list of probes."""
    keys = [None, "", "a", "a\0", "ä", "\U0001f600", *(f"k{i:05d}" for i in range(0, 12_000, 2))]
    index = {0: ["a"], 1: ["k05001"], 2: [f"k{i:05d}" for i in range(1, 12_000, 3)], 3: ["\uffff"], 4: ["", "ä"]}
    entries = [(r, k, 10 * i) for r, ks in index.items() for i, k in enumerate(ks)]
    got = R.lower_bound(spark.createDataFrame(entries, "run_id long, last_key string, block_offset long"), spark.createDataFrame([(k,) for k in keys], "key string").repartition(1)).collect()
    want = set()
    for r, ks in index.items():
        raw = [k.encode() for k in ks]
        for k in keys:
            i = len(ks) if k is None else bisect.bisect_left(raw, k.encode())
            want.add((r, k, *((ks[i], 10 * i) if i < len(ks) else (None, None))))
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_probes_are_spread(spark, small):
    keys = bloom.spread(e.catalogue._probes(spark, small))
    assert keys.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_filters_side_by_side(spark):
    """Runs of one and of several sizes, more than one word and one block of them, against bit by bit; a null probe passes nothing."""
    held = {r: [f"r{r}k{i}" for i in range(3 + (r % 3 == 0) * 40)] for r in range(150)}
    rows = spark.createDataFrame([(r, k) for r, ks in held.items() for k in ks], "run_id long, key string")
    probes = [f"r{r}k{i}" for r in range(0, 150, 7) for i in range(3)] + [f"x{i}" for i in range(700)]
    params, bits = bloom.build(rows)
    of = {r.run_id: (r.m, r.k) for r in params.collect()}
    bit = {r: set() for r in held}
    for r in bits.collect():
        bit[r.run_id].add(r.bit)

    def passes(r, key):
        h, (m, k) = hashlib.md5(key.encode()).hexdigest(), of[r]
        return all((int(h[:12], 16) + i * int(h[12:24], 16)) % m in bit[r] for i in range(k))

    want = {(r, len(probes) + 1, c := sum(passes(r, x) for x in probes), h := len(set(held[r]) & set(probes)), c - h) for r in held}
    df = bloom.false_positives(params, bits, rows, spark.createDataFrame([(k,) for k in [*probes, None]], "key string"))
    assert {tuple(r) for r in df.collect()} == want
    assert len({m for m, _ in of.values()}) == 2


def test_filter_probes_make_no_row_of_probe_and_run(spark, small):
    df = e.queries()["bloom_probe"](spark, small)
    assert len(df.collect()) == len(runs())
    todo, plans = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        plans.append(p)
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
    made = [p.metrics().apply("numOutputRows").value() for p in plans if p.nodeName() == "CartesianProduct"]
    assert made and max(made) < N


@pytest.mark.parametrize("rows, bits", [(1, 1), (16, 8), (17, 64), (1001, 130)])
def test_column_sums(rows, bits):
    given = np.random.default_rng(rows).integers(0, 2, (rows, bits), np.uint8)
    packed = np.packbits(given, axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("u8")
    assert bloom.column_sums(packed)[:bits].tolist() == given.sum(0).tolist()
