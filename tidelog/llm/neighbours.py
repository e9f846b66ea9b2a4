"""Approximate nearest neighbours: a hierarchical navigable small-world graph in each shard.

Rows are dealt to shards of about SHARD vectors. A shard's graph has layers of falling
size, into which nodes are inserted in small batches by searching what is there; each
layer is one flat array of neighbour numbers, padded with -1. A search walks
down from the top layer with a narrow beam and through the lowest with a wide one, for a
block of queries at once. Every block of queries meets every shard in one of about TASKS tasks,
which read both where they are stored; a task keeps each query's best of all its shards. Results
carry exact double-precision cosines and merge by rank.

Null, zero and non-finite vectors take no part, nor do rows without an id; of rows that
share an id the least vector counts; vectors of one direction are one node, of which all
are scored and equal ones keep their smallest ids, so ties, multiples and copies are settled
exactly; vectors of another length are shards of their own and
are never compared; an empty table gives an empty result; extra columns are not read.
"""

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.llm.shared import Scratch

SHARD, QUERIES, LINKS, BEAM, STEP = 4096, 2048, 16, 128, 4
#: Nodes inserted at once, and the beam that finds their neighbours.
INSERTED, EFFORT = 128, 64
#: Tasks that search, query blocks that one of them holds, and shards that one task builds at most on average.
TASKS, HELD, BUILT = 1000, 16, 32
K = 5
EMPTY = -(2**63)


def levels(n: int, ids: np.ndarray) -> np.ndarray:
    """Each node's top layer: geometric, from a hash of its id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.minimum((-np.log(u) / np.log(LINKS)).astype(np.int64), 4)


def diverse(sims: np.ndarray, gram: np.ndarray, links: int) -> np.ndarray:
    """Columns that each row keeps, in order, of candidates by falling similarity (-inf: none); -1 pads.

    A candidate is passed over when one already taken is nearer to it than the row's own node
    is, and fills up the row only at the end."""
    m, pool = sims.shape
    there = sims > -np.inf
    taken, count = np.zeros((m, pool), bool), np.zeros(m, np.int64)
    for j in range(pool):
        rival = np.where(taken[:, :j], gram[:, :j, j], -np.inf).max(axis=1, initial=-np.inf)
        taken[:, j] = there[:, j] & (rival <= sims[:, j]) & (count < links)
        count += taken[:, j]
    order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :links]
    return np.where(np.take_along_axis(there, order, 1), order, -1)


def chosen(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, pool: int, links: int) -> np.ndarray:
    """Neighbours of each node out of its candidates, -1 and itself being none."""
    padded = np.where(near < 0, 0, near)
    sims = np.einsum("mpd,md->mp", x[padded], x[nodes])
    sims[(near < 0) | (near == nodes[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")[:, :pool]
    near, sims = np.take_along_axis(padded, order, 1), np.take_along_axis(sims, order, 1)
    v = x[near]
    keep = diverse(sims, v @ v.transpose(0, 2, 1), links)
    return np.where(keep < 0, -1, np.take_along_axis(near, np.maximum(keep, 0), 1))


def link_back(x: np.ndarray, flat: np.ndarray, new: np.ndarray, rows: np.ndarray) -> None:
    """Adds new nodes to their neighbours' rows; a row that is too full keeps diverse near ones."""
    width, more = flat.shape[1], {}
    for k, row in zip(new.tolist(), rows.tolist()):
        for t in row:
            if t >= 0:
                more.setdefault(t, []).append(k)
    full = []
    for t, ks in more.items():
        have = flat[t][flat[t] >= 0].tolist()
        both = have + [k for k in ks if k not in have]
        if len(both) <= width:
            flat[t, : len(both)] = both
        else:
            full.append((t, both))
    full.sort(key=lambda f: len(f[1]))
    for a in range(0, len(full), 64):
        part = full[a : a + 64]
        near = np.full((len(part), len(part[-1][1])), -1, np.int64)
        for k, (_, both) in enumerate(part):
            near[k, : len(both)] = both
        nodes = np.array([t for t, _ in part])
        flat[nodes] = -1
        flat[nodes, :width] = chosen(x, nodes, near, near.shape[1], width)


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """Layers of a shard, lowest first: node numbers and flat neighbour arrays.

    Nodes are inserted in the order of a hash, in batches no larger than what is there already.
    A batch walks down the graph so far, and in each of a node's layers what its beam finds
    there, and the batch's own nodes, are the candidates for its row."""
    n, top = len(x), levels(len(x), ids)
    order = np.argsort((ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (ids.astype(np.uint64) >> np.uint64(32)), kind="stable")
    flats = [np.full((n, 2 * LINKS), -1, np.int32) for _ in range(int(top.max()) + 1)]
    entry, done, every = int(order[0]), 1, np.arange(n)
    while done < n:
        batch = order[done : done + min(done, INSERTED)]
        start = np.full((len(batch), 1), entry, np.int64)
        for k in range(int(top.max()), -1, -1):
            if top[entry] >= k:
                start, _ = walk(x, every, flats[k], x[batch], start, EFFORT)
            own = top[batch] >= k
            if not own.any():
                continue
            new = batch[own]
            found = start[own] if top[entry] >= k else np.zeros((len(new), 0), np.int64)
            near = np.hstack([np.where(found < n, found, -1), np.broadcast_to(new, (len(new), len(new)))])
            rows = chosen(x, new, near, 2 * LINKS, LINKS)
            flats[k][new, : rows.shape[1]] = rows
            link_back(x, flats[k], new, rows)
        best = int(batch[np.argmax(top[batch])])
        entry, done = best if top[best] > top[entry] else entry, done + len(batch)
    return {"layers": [(np.flatnonzero(top >= k), f[top >= k]) for k, f in enumerate(flats)], "entry": entry}


def walk(x, nodes, flat, q, start, beam: int):
    """Best-first search of one layer for all queries at once; (node, similarity) by falling similarity."""
    n, m = len(x), len(q)
    row = np.full(n, -1, np.int64)
    row[nodes] = np.arange(len(nodes))
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    lines = np.arange(m)[:, None]
    best = np.full((m, beam), n, np.int64)
    best[:, : start.shape[1]] = start[:, :beam]
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    score = np.where(best < n, np.einsum("mkd,md->mk", padded[best], q), -np.inf).astype(np.float32)
    seen[lines, best] = True
    done = best == n
    while True:
        open_ = np.where(done, -np.inf, score)
        pick = np.argpartition(-open_, STEP - 1, axis=1)[:, :STEP] if beam > STEP else np.arange(beam)[None, :].repeat(m, 0)
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        at = np.where(live, np.take_along_axis(best, pick, 1), n)
        nxt = np.where(live[:, :, None], flat[row[np.minimum(at, n - 1)]], -1).reshape(m, -1).astype(np.int64)
        nxt[nxt < 0] = n
        nxt = np.sort(nxt, axis=1)
        nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = n
        nxt[seen[lines, nxt]] = n
        keep = (nxt < n).any(axis=0)
        nxt = nxt[:, keep]
        if not nxt.shape[1]:
            continue
        seen[lines, nxt] = True
        s = np.where(nxt < n, np.einsum("mkd,md->mk", padded[nxt], q), -np.inf).astype(np.float32)
        all_b, all_s = np.hstack([best, nxt]), np.hstack([score, s])
        all_d = np.hstack([done, nxt == n])
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        best, score, done = (np.take_along_axis(v, top, 1) for v in (all_b, all_s, all_d))
    o = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(best, o, 1), np.take_along_axis(score, o, 1)


def search(x: np.ndarray, graph: dict, q: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers of each query's beam; len(x) where there are fewer."""
    start = np.full((len(q), 1), graph["entry"], np.int64)
    for k in range(len(graph["layers"]) - 1, -1, -1):
        nodes, flat = graph["layers"][k]
        width = min(beam if k == 0 else 16, max(len(nodes), 1))
        start, _ = walk(x, nodes, flat, q, start, width)
    return start


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda c: c != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def index(rows: DataFrame, scratch: Scratch, k: int, shard_rows: int = SHARD) -> tuple[DataFrame, int]:
    """One row for each shard: distinct vectors, their k + 1 smallest ids, and the graph's flat arrays."""
    n = rows.count()
    shards = max(1, -(-n // shard_rows))

    def make(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        dim = table["dim"][0].as_py()
        v = table["v"].combine_chunks()
        v = (v.flatten() if not isinstance(v, pa.ChunkedArray) else v.chunk(0).flatten()).to_numpy().reshape(-1, dim)
        order = np.argsort(ids)
        ids, v = ids[order], v[order]
        _, first, inverse = np.unique(v, axis=0, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        by = np.argsort(inverse, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(inverse[by], np.arange(len(first)))[inverse[by]]
        some = rank <= k
        own = np.full((len(first), k + 1), EMPTY, np.int64)
        own[inverse[by][some], rank[some]] = ids[by[some]]
        # One node for each direction: multiples of a vector agree far beyond these 20 bits.
        u = unit(v[first])
        _, lead, node = np.unique(np.round(u * (1 << 20)).astype(np.int32), axis=0, return_index=True, return_inverse=True)
        g = build(ids[first[lead]], u[lead].astype(np.float32))
        raw = lambda a: np.ascontiguousarray(a).tobytes()
        cols = {"node": [raw(node.reshape(-1).astype(np.int32))], "dim": [dim], "shard": [table["shard"][0].as_py()], "ids": [raw(own)], "vectors": [raw(v[first])], "entry": [g["entry"]],
                "nodes": [[raw(a.astype(np.int32)) for a, _ in g["layers"]]], "links": [[raw(f) for _, f in g["layers"]]]}
        return pa.table(cols, schema=pa.schema([("node", pa.binary()), ("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("entry", pa.int64()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(max(6, min(shards, TASKS), shards // BUILT), "dim", "shard")
    made = dealt.groupBy("dim", "shard").applyInArrow(make, "node binary, dim int, shard int, ids binary, vectors binary, entry long, nodes array<binary>, links array<binary>")
    return scratch.keep(made, "index"), shards


@contextlib.contextmanager
def one_row_batches(spark):
    """A row holds a whole shard and a block of queries; a worker gets one at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def nearest(df: DataFrame, query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, beam: int = BEAM, shard_rows: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for the rows that the condition `query` on vec_id picks."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = scratch.keep(valid(df, vec_id, vector), "vectors")
    shards_df, shards = index(rows, scratch, k, shard_rows)
    asked = rows.where(query)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    packed = asked.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("q"))
    packed = packed.select("dim", "block", F.col("q.vec_id").alias("qid"), F.col("q.v").alias("qv"))

    def work(batches):
        shard, best = None, {}
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                if shard != (dim, r["shard"]):
                    shard = (dim, r["shard"])
                    own = np.frombuffer(r["ids"], np.int64).reshape(-1, k + 1)
                    v = np.frombuffer(r["vectors"], np.float64).reshape(-1, dim)
                    node = np.frombuffer(r["node"], np.int32)
                    by = np.argsort(node, kind="stable")
                    edge = np.searchsorted(node[by], np.arange(node.max() + 2))
                    x = unit(v[by[edge[:-1]]]).astype(np.float32)
                    links = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(f, np.int32).reshape(-1, 2 * LINKS)) for a, f in zip(r["nodes"], r["links"])]
                    vn = np.linalg.norm(v, axis=1)
                q = np.array(r["qv"], np.float64)
                found = search(x, {"layers": links, "entry": r["entry"]}, unit(q).astype(np.float32), beam)
                qn = np.linalg.norm(q, axis=1)
                for j, qid in enumerate(r["qid"]):
                    some = found[j][found[j] < len(x)]
                    at = np.concatenate([by[edge[n] : edge[n + 1]] for n in some.tolist()])
                    ids = own[at].ravel()
                    s = np.repeat((v[at] * q[j]).sum(axis=1) / (vn[at] * qn[j]), k + 1)
                    ok = (ids != EMPTY) & (ids != qid)
                    ids, s = ids[ok], s[ok]
                    if qid in best:
                        ids, s = np.concatenate((best[qid][0], ids)), np.concatenate((best[qid][1], s))
                    o = np.lexsort((ids, -s))[:k]
                    best[qid] = ids[o], s[o]
        if best:
            n = [len(ids) for ids, _ in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), n)), *(pa.array(np.concatenate([x[c] for x in best.values()])) for c in (0, 1))], ["query_id", "vec_id", "score"])

    # Every block meets every shard: the stated query set against all rows. Neither is copied for the other.
    held = -(-blocks // HELD)
    pairs = shards_df.coalesce(min(shards, max(1, TASKS // held))).join(packed.repartition(held).hint("shuffle_replicate_nl"), "dim")
    with one_row_batches(spark):
        got = scratch.keep(pairs.mapInArrow(work, "query_id long, vec_id long, score double"), "found")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(50)) == 0)
