"""Removal of bytes covered by repeated 200-byte strings: prefix doubling over sampled suffixes.

Ranks of ever longer prefixes are made from pairs of shorter ones (1, 2, 4 ... 64, 128 bytes,
and 200 from two overlapping 128s). Ranks are 64-bit names, so a pair needs no neighbour's
row until names are compared. Three comparisons are distributed, each over what the one
before left open:

1. 64 bytes, at sampled positions: each window of 200 bytes names itself by the smallest
   64-byte rank inside it, which only its content decides. Consecutive windows with one
   name are a run. A name found once rules out its whole run.
2. The run's whole stretch, by (name, rank of the stretch): runs that share it are repeated
   in all their windows.
3. 200 bytes, at every position of the runs still open and of one run of each settled group
   that shares a name with an open one: counts of equal ranks decide the rest.

Null and empty texts, and texts under 200 bytes, lose nothing; matches never leave their
document; overlapping occurrences in one document count; repeated rows, with or without
ids, are occurrences of their own; long texts are read whole; an empty table gives an empty
result; extra columns are not read.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.llm.shared import Scratch, flat_bytes, partitions

LENGTH, GRAM = 200, 64
MOST = LENGTH - GRAM + 1  # windows of a run; only runs with a name at several places are longer, and are cut
CHUNK = 8 << 20

_U = np.uint64
_MIX = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xDB4F0B9175AE2165, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _name(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def _letters(seed: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 2**62, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def doubled(data: np.ndarray, rounds: int, seed: int = 1) -> np.ndarray:
    """Ranks of the 2**rounds bytes from each position on, each round from pairs of the one before."""
    h, m = _letters(seed)[data], 1
    for k in range(rounds):
        h = _name(h[:-m] * _MIX[k] + h[m:]) if len(h) > m else h[:0]
        m *= 2
    return h


def ranks_200(data: np.ndarray, seed: int) -> np.ndarray:
    h = doubled(data, 7, seed)
    return _name(h[:-72] * _MIX[8] + h[72:])


def _documents(batch: pa.RecordBatch, column: int):
    """Runs of documents of about CHUNK bytes: (first, offsets, bytes)."""
    data, offs = flat_bytes(batch.column(column))
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1)
        b = min(b, n)
        yield a, offs[a : b + 1] - offs[a], data[offs[a] : offs[b]]
        a = b


SPAN = LENGTH - GRAM  # of the 64-byte positions in a window, the last one's offset


def _slide(x: np.ndarray, best) -> np.ndarray:
    """best of every SPAN + 1 neighbours."""
    for s in (1, 2, 4, 8, 16, 32, 64, SPAN + 1 - 128):
        x = best(x[:-s], x[s:])
    return x


def _twice_within(h, least, first, long, name) -> np.ndarray:
    """Runs whose stretch has its smallest rank at two places."""
    pad = np.zeros(SPAN, _U)
    places = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), np.maximum) == h)
    pair = np.flatnonzero((h[places[1:]] == h[places[:-1]]) & (places[1:] - places[:-1] <= SPAN))
    out = np.zeros(len(first), bool)
    q, r = places[pair], places[pair + 1]
    k, last = np.searchsorted(first + long - 1, q - SPAN), np.searchsorted(first, r, "right")
    while len(q):
        q, k, last = (x[k < last] for x in (q, k, last))
        out[k[name[k] == h[q]]] = True
        k = k + 1
    return out


def runs_of(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, name, rank of the stretch, first window, windows - 1) of every run."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty.astype(_U), empty.astype(_U), empty, empty
    h = doubled(data, 6)
    least = _slide(h, np.minimum)
    size = offs[1:] - offs[:-1]
    windows = np.maximum(size - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(size)), windows)
    at = np.repeat(offs[:-1] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
    if not len(at):
        return empty, empty.astype(_U), empty.astype(_U), empty, empty
    name = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    long = np.diff(np.append(start, len(at)))
    # A run in which its name's place comes twice may repeat within itself: it is cut in two,
    # so that its name counts twice.
    pieces = -(-long // MOST)
    pieces[_twice_within(h, least, at[start], long, name[start]) & (long > 1) & (pieces < 2)] = 2
    if pieces.max() > 1:
        width = -(-long // pieces)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + step * np.repeat(width, pieces)
        long = np.diff(np.append(start, len(at)))
    first = at[start]
    # The stretch is named by doubled ranks of 64 bytes that tile it, the last one ending with it.
    end = first + long - 1 + LENGTH
    rank = long.astype(_U) * _MIX[0]
    for k in range(0, LENGTH + MOST + GRAM, GRAM):
        p = np.minimum(first + k, end - GRAM)
        rank = _name(rank * _MIX[1] + h[p])
    return doc[start], name[start], rank, first - offs[doc[start]], long - 1


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), F.col(f"`{doc_id}`"), t, F.octet_length(t)).alias("k2"), t.alias("text"))


def _bucketed(docs: DataFrame, scratch: Scratch, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, text) of every row, bucketed by key: texts move once, and what is joined
    to them by key later comes to them. Copies have different ids, thus different keys."""
    spark, table = docs.sparkSession, f"repeats_{uuid.uuid4().hex}"
    keyed = _keyed(docs, doc_id, text).repartition(partitions(spark), "k1", "k2")
    keyed.write.format("parquet").bucketBy(partitions(spark), "k1", "k2").option("compression", "zstd").option("path", scratch.path("texts")).saveAsTable(table)
    out = spark.table(table)
    scratch.drop()
    spark.sql(f"DROP TABLE {table}")  # its files stay, and the frame knows them
    return out


def _list(batch_docs: int, doc: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    offs = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch_docs)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def _runs(batches):
    for b in batches:
        parts = [[] for _ in range(5)]
        for a, offs, data in _documents(b, 2):
            got = runs_of(offs, data)
            for p, v in zip(parts, (got[0] + a, *got[1:])):
                p.append(v)
        doc, name, rank, first, more = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        lists = [_list(b.num_rows, doc, x, t) for x, t in ((name.astype(_U).view(np.int64), pa.int64()), (rank.astype(_U).view(np.int64), pa.int64()), (first.astype(np.int32), pa.int32()), (more.astype(np.int32), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["k1", "k2", "v", "s", "i", "m"])


def _windows(batches):
    """Ranks of 200 bytes in the asked runs. In a batch, equal ones are sent once and the rest as known."""
    for b in batches:
        data, offs = flat_bytes(b.column(0))
        asked = b.column(1)
        lo = asked.offsets.to_numpy().astype(np.int64)
        flat = asked.flatten()
        lo -= lo[0]
        rid, first, more = (flat.field(n).to_numpy().astype(np.int64) for n in ("rid", "i", "m"))
        doc = np.repeat(np.arange(b.num_rows), lo[1:] - lo[:-1])
        begin = offs[:-1][doc] + first
        stretch = more + LENGTH
        for a in range(0, len(rid), 20_000):
            z = slice(a, a + 20_000)
            n = stretch[z]
            base = np.cumsum(n) - n
            own = data[np.repeat(begin[z] - base, n) + np.arange(n.sum())]
            inside = np.arange(len(own)) - np.repeat(base, n)
            keep = np.flatnonzero(inside <= np.repeat(more[z], n))
            h1, h2 = ranks_200(own, 2)[keep], ranks_200(own, 3)[keep] >> _U(33)
            ref = (np.repeat(rid[z], n)[keep] * 256 + inside[keep]) * 2
            _, at, back, count = np.unique(h1, return_index=True, return_inverse=True, return_counts=True)
            same = h2 == h2[at][back]  # a clash of one rank is sent as it is
            lead = np.zeros(len(h1), bool)
            lead[at] = True
            twice = (np.bincount(back, weights=same) > 1)[back] & same
            rest = twice & ~lead
            ref = ref + twice
            h1 = np.where(rest, ref.astype(_U), h1)
            h2 = np.where(rest, _U(0), (h2 << _U(1) | _U(1)) & _U(0x7FFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.astype(np.int32)), pa.array(ref, pa.int64())], ["h1", "h2", "ref"])


def cover(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows (first, last) cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, b) for a, b in out]


def _merged(batches):
    """Spans of window starts that touch become one."""
    for b in batches:
        out = []
        for spans in b.column(2).to_pylist():
            mine: list[dict] = []
            for x in sorted(spans, key=lambda x: x["a"]):
                if mine and x["a"] <= mine[-1]["b"] + 1:
                    mine[-1]["b"] = max(mine[-1]["b"], x["b"])
                else:
                    mine.append(x)
            out.append(mine)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["k1", "k2", "spans"])


def _cut(batches):
    for b in batches:
        texts = b.column(1).cast(pa.large_binary()).to_pylist()
        cols = [[] for _ in range(4)]
        for t, spans in zip(texts, b.column(2).to_pylist()):
            gone = cover(len(t), [(x["a"], x["b"]) for x in spans or ()])
            h, at = hashlib.sha256(), 0
            for x, y in gone:
                h.update(t[at:x])
                at = y
            h.update(t[at:])
            for c, v in zip(cols, (len(t), sum(y - x for x, y in gone), len(gone), h.hexdigest())):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated(src: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, spans): first and last start of repeated windows, for each text of `_bucketed` that has any."""
    runs = scratch.keep(src.select("k1", "k2", "text").mapInArrow(_runs, "k1 long, k2 long, v array<long>, s array<long>, i array<int>, m array<int>"), "runs")
    # Names found twice: partial counts first, so a name's frequency doesn't matter.
    twice = runs.select(F.explode("v").alias("v")).groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    rows = runs.select("k1", "k2", F.explode(F.arrays_zip("v", "s", "i", "m")).alias("r")).select("k1", "k2", "r.v", "r.s", "r.i", "r.m")
    open_ = scratch.keep(rows.join(twice, "v"), "open")
    scratch.drop("runs")
    groups = scratch.keep(open_.groupBy("v", "s").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "i", "m")).alias("one")), "groups")
    single, settled = groups.where("c = 1"), groups.where("c > 1")
    leaders = settled.join(single.select("v").distinct(), "v", "left_semi")
    asked = single.union(leaders).select("one.*").withColumn("rid", F.monotonically_increasing_id())
    asked = scratch.keep(asked, "asked")
    whole = open_.join(settled.select("v", "s"), ["v", "s"]).select("k1", "k2", F.col("i").alias("a"), (F.col("i") + F.col("m")).alias("b"))
    whole = scratch.keep(whole, "whole")
    scratch.drop("open", "groups")
    per_doc = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("rid", "i", "m")).alias("asked"))
    ranks = src.join(per_doc, ["k1", "k2"]).select("text", "asked").mapInArrow(_windows, "h1 long, h2 int, ref long")
    seen = F.count("*").over(W.partitionBy("h1", "h2"))
    hits = ranks.withColumn("c", seen).where("c > 1 or pmod(ref, 2) = 1").select(F.expr("ref div 512").alias("rid"), F.expr("cast(ref div 2 % 256 as int)").alias("off"))
    hits = scratch.keep(hits, "hits")
    scratch.drop()
    placed = hits.groupBy("rid").agg(F.array_sort(F.collect_set("off")).alias("offs")).join(asked, "rid")
    # Neighbouring windows become one span before they travel.
    spans = placed.select("k1", "k2", "i", F.explode(_joined("offs")).alias("x")).select("k1", "k2", (F.col("i") + F.col("x.a")).alias("a"), (F.col("i") + F.col("x.b")).alias("b"))
    out = scratch.keep(whole.union(spans).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")).mapInArrow(_merged, "k1 long, k2 long, spans array<struct<a:int,b:int>>"), "spans")
    scratch.drop("hits", "asked", "whole")
    return out


def _joined(offs: str):
    """Runs of consecutive numbers of a sorted array as (a, b)."""
    kind = "array<struct<a:int,b:int>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        one = F.array(F.struct(x.alias("a"), x.alias("b")))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), x.alias("b"))))
        return F.when(F.size(acc) == 0, one).when(last["b"] == x - 1, longer).otherwise(F.concat(acc, one))

    return F.aggregate(offs, F.expr(f"cast(array() as {kind})"), step)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = _bucketed(docs, scratch, doc_id, text)
    spans = repeated(texts, scratch)
    key = docs.schema[doc_id].dataType.simpleString()
    joined = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
