"""The persistent store against a dict, and the scalar functions' fixed values."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.operators import trace, view
from tidelog.operators.trace import Lru
from tidelog.sources import fs, manifest as catalog, wal
from tidelog.store import Store
from tidelog.streaming import ingest


def test_random_script_matches_a_dict(spark, tmp_path):
    root, rnd, want = f"file://{tmp_path}/s", random.Random(4), {}
    store = Store(spark, root, memtable_bytes=1 << 20, merge_at=3)
    for step in range(60):
        key = f"k{rnd.randrange(12)}"
        if rnd.random() < 0.3:
            store.delete(key)
            want.pop(key, None)
        else:
            store.set(key, f"v{step}")
            want[key] = f"v{step}"
        if step % 17 == 16:
            store.flush()
    assert {r.key: r.value for r in store.live().collect()} == want
    store.flush()
    again = Store(spark, root)
    assert {r.key: r.value for r in again.live().collect()} == want
    assert again.get("k1") == want.get("k1") and again.get("zzz") is None
    again.set("new", "")
    assert again.get("new") == ""
    again.flush()
    again.compact()
    assert again.stats()["sstables"] == 1 and again.sweep() == 0
    assert all(x["size_bytes"] > 0 for x in again.manifest.entries)
    again.grace_ms = 0
    assert again.sweep() > 0 and {r.key: r.value for r in again.live().collect()} == want | {"new": ""}
    with pytest.raises(ValueError):
        again.set("", "x")


def test_stale_writer_conflicts(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    a, b = Store(spark, root), Store(spark, root)
    a.set("x", "1")
    a.flush()
    b.set("x", "2")
    with pytest.raises(catalog.ManifestConflict):
        b.flush()


def test_fixed_values(spark):
    assert [hex(x) for x in fn.crc32c_many([b"123456789", b"", bytes(range(256)) * 16])] == ["0xe3069283", "0x0", "0x9c71fe32"]
    assert fn.varint_bytes(624485).hex() == "e58e26" and fn.varint_decode_bytes(bytes.fromhex("e58e26")) == (624485, 3)
    assert spark.range(1).select(fn.varint_encode(F.lit(624485).cast("long"))).first()[0] == "E58E26"
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 127, 128, 16383, 16384)], "n long").select(fn.varint_size("n")).collect()]
    assert got == [1, 1, 2, 2, 3]
    row = spark.range(1).select(fn.percent_decode(F.lit("a%2Fb+c")), fn.percent_decode(F.lit("a%ZZ")), fn.percent_encode_path(F.lit("a b/é~*+"))).first()
    assert tuple(row) == ("a/b+c", None, "a%20b/%C3%A9~%2A%2B")


def test_log_files_stop_at_a_torn_tail(spark, tmp_path):
    data = wal.encode(b"a", b"1") + wal.encode(b"b", None) + wal.encode(b"c", b"")
    (tmp_path / "x.wal").write_bytes(data + b"\x01")
    got = sorted((bytes(r.key), None if r.value is None else bytes(r.value), r.tomb) for r in wal.read(spark, str(tmp_path / "x.wal")).collect())
    assert got == [(b"a", b"1", False), (b"b", None, True), (b"c", b"", False)]


def test_a_killed_store_reads_its_log(spark, tmp_path):
    root = f"file://{tmp_path}/k"
    store = Store(spark, root)
    store.write([("a", "1"), ("b", "é"), ("a", "2")])
    store.delete("b")
    again = Store(spark, root)  # no flush came before
    assert again.get("a") == "2" and again.get("b") is None and again.seq == 4
    again.flush()
    assert not list((tmp_path / "k/wal").glob("*.wal")) and Store(spark, root).get("a") == "2"
    again.write([("c", "3"), ("d", "4")])
    file = next((tmp_path / "k/wal").glob("*.wal"))
    file.write_bytes(file.read_bytes()[:-1])  # a torn tail
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    last = Store(spark, root)
    assert last.get("c") == "3" and last.get("d") is None and last.get("a") == "2"


def test_failed_merges_are_counted(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/f", merge_at=2)
    monkeypatch.setattr(store, "compact", lambda: 1 / 0)
    for k in range(3):
        store.set("k", str(k))
        store.flush()
    assert store.stats() == {"sstables": 3, "active_entries": 0, "compaction_failures": 2} and store.get("k") == "2"


def test_bulk_writes_come_after_all_before(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/b")
    store.set("x", "1")
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1, "y", "2", False)], "seq long, key string, value string, tomb boolean"))
    store.append(spark.createDataFrame([(2, "x", "3", False), (3, "y", None, True)], "seq long, key string, value string, tomb boolean"))
    assert store.get("x") == "3" and store.get("y") is None and store.seq == 3


def test_ranges_are_read_and_counted(spark, tmp_path):
    (tmp_path / "r").write_bytes(bytes(range(100)))
    reads = fs.Reads(spark)
    assert reads.size(f"file://{tmp_path}/r") == 100 and reads.read(f"file://{tmp_path}/r", 10, 5) == bytes(range(10, 15))
    with pytest.raises(EOFError):
        reads.read(f"file://{tmp_path}/r", 98, 3)
    assert (reads.sizes, reads.reads, reads.bytes) == (1, 2, 5)


def test_manifest_without_some_runs():
    m = catalog.Manifest(3, [{"id": 1}, {"id": 2}], 7)
    assert m.without(1, 9) == catalog.Manifest(3, [{"id": 2}], 7)


def test_lru_by_key():
    c = Lru()
    for k in "abc":
        c.put(k, 2)
    assert c.get("a") == 2 and c.get("z") is None
    c.put("b", 5)
    assert c.used == 9 and c.remove("c") and not c.remove("c") and c.pop_lru() == ("a", 2) and c.used == 5


def test_commits_and_ledgers_by_hand(spark):
    rows = [("o", k, "w", g) for k, g in enumerate([1, 0, 0, 1, 3, 2, 2])]
    got = trace.cas(spark.createDataFrame(rows, "object string, seq long, writer string, expected_gen long")).orderBy("seq").collect()
    assert [r.outcome == "committed" for r in got] == [False, True, False, True, False, True, False]
    moves = [("alloc", 60, 0), ("resize", 90, 60), ("resize", 110, 90), ("remap", 100, 90), ("alloc", 1, 0), ("remap", 20, 100), ("free", 20, 0)]
    df = spark.createDataFrame([(0, k, *m) for k, m in enumerate(moves)], "ledger long, seq long, op string, bytes long, old_bytes long")
    got = trace.admission(df, 100).orderBy("seq").collect()
    assert [(r.ok, r.live) for r in got] == [(True, 60), (True, 90), (False, 90), (True, 100), (False, 100), (True, 20), (True, 0)] and got[-1].refused == 2


def test_several_batches_and_a_second_call(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("event_id", "timestamp_ntz'2024-01-01' as ts", "user_id", "event_type", "1d as value", "concat('p', event_id) as props").coalesce(1).write.parquet(str(tmp_path / "made" / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / "made" / name).glob("part-*.parquet")).rename(tmp_path / "in" / f"events-{name}.parquet")

    put("a", [(1, 1, "view"), (2, 2, "view")])
    put("b", [(3, 1, "error"), (4, 3, "view")])
    runs = ingest.ingest(spark, str(tmp_path / "in"), f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out/runs").glob("run_id=*"))) == 2
    put("c", [(5, 1, "view")])
    ingest.ingest(spark, str(tmp_path / "in"), f"file://{tmp_path}/out")
    got = {r.key: r.value for r in view.live(spark.read.parquet(runs)).collect()}
    assert got == {"u/000001": "p5", "u/000002": "p2", "u/000003": "p4"}
