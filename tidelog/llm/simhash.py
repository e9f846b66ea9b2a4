"""Near-duplicates by SimHash with multi-index hashing.

`group` links fingerprints by their distance alone. `similar` links texts whose shingle sets
have a Jaccard similarity of at least 0.8, and misses none. First each fingerprint meets the
least one within the same distance, by the same tables; the stars that whole sets confirm are
contracted. What the distance can't reach is found exactly after that: of two such sets each has
a fifth of its shingles, the rarest in one common order, of which one at least is in both. Texts
of different components that share one are a bucket. Each member first meets the bucket's leader;
what that links is one component, and only members of different components meet after that, so
a group of copies costs its rows and not its pairs. Whoever meets is compared by whole sets.

Null and empty texts have the fingerprint zero and are linked like any other; a text of
any length is read whole; equal fingerprints or texts are one node, so copies and repeated rows
cost nothing beyond their own rows; rows without an id keep their fingerprint, and their
group is that of the fingerprint (null if no member has an id); an empty table gives an
empty result; extra columns are not read by `group` and `similar`, and `deduplicate` passes
them through under their own names.
"""

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.shared import Scratch, partitions, sliced, texts_of, worker_cache

SEED, WORDS, DISTANCE = 42, 4, 4
#: Near copies: words of a shingle, least Jaccard similarity.
COPY_WORDS, SIMILARITY = 5, 0.8
#: Shingles of one text in SAMPLE are counted, and the OFTEN most frequent that FEW of them have come last
#: in the order. That only spreads the work: any order finds the same pairs.
SAMPLE, FEW, OFTEN = 16, 4, 200_000
#: Leaders go on meeting buckets until the pairs left to look at are so many for each row at most.
LINEAR = 1000
#: Parts of a set that are counted for a first look at a pair.
SKETCH = 128


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; fewer words are one shingle, no words none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, "<u8")
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    first = np.concatenate(([0], ends[:-words])).tolist()
    last = (ends[words - 1 :] - 1).tolist()
    view, one = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([one(view[a:b], SEED) for a, b in zip(first, last)], "<u8")


def majority(h: np.ndarray) -> int:
    """The bits set in over half of h."""
    n = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        n += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * n > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    return majority(shingles(text, words))


def fingerprints(df: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in texts_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, fp long")


def segments(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of n segments that cover the fingerprint."""
    cuts = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most `distance` bits apart, each once.

    With more segments than half the errors, some segment has at most distance // parts
    errors. One side of each table holds the segments as they are; the other enumerates
    the small Hamming ball around its own segment. Of two values that differ, the bits to
    be flipped are set in one or the other, so with one error it is enough to clear bits:
    the fingerprint that has the bit reaches the one that has it not."""
    radius = distance // parts
    if radius > 1:
        raise ValueError("take more segments: balls of radius two are not built")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") != F.col("b"))
    asks, table = _tables(fps, ["fp"], parts, radius, {"fp": "a"}, {"fp": "b"})
    met = asks.join(table, (F.col("bucket") == F.col("own")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tables(fps: DataFrame, columns: list[str], parts: int, radius: int, asking: dict, asked: dict) -> tuple[DataFrame, DataFrame]:
    """(asks, table): rows of the Hamming balls under `bucket`, rows as they are under `own`; the
    dicts name what each side carries."""
    cuts = [(c, s, w) for c in columns for s, w in segments(parts)]
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(c, s).bitwiseAND(F.lit((1 << w) - 1)).alias("v"), F.lit(w).alias("w")) for k, (c, s, w) in enumerate(cuts)])
    carried = list(dict.fromkeys([*asking, *asked]))
    key = lambda k, v, name: (F.col(k).cast("long") * (1 << 40) + F.col(v)).alias(name)
    split = fps.select(*carried, F.explode(tables).alias("t")).select(*carried, F.col("t.k").alias("segment"), F.col("t.v").alias("v"), F.col("t.w").alias("w"))
    table = split.select(*[F.col(c).alias(n) for c, n in asked.items()], key("segment", "v", "own"))
    ball = F.filter(F.concat(F.array(F.col("v")), F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.when(F.call_function("shiftright", F.col("v"), i).bitwiseAND(F.lit(1)) == 1, F.col("v") - F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda x: x.isNotNull())
    asks = split.select(*carried, "segment", F.explode(ball if radius else F.array("v")).alias("u")).select(*[F.col(c).alias(n) for c, n in asking.items()], key("segment", "u", "bucket"))
    return asks, table


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes with an edge.

    Large-star and small-star steps alternate until a round leaves the edges as they were;
    each round is written, and only its number of edges comes to the driver. The neighbours of
    a star's centre are dealt by (centre, salt), and its least neighbour goes to the salts that
    it has, so no task gets a whole star."""
    salts = partitions(edges.sparkSession)

    def with_least(e):
        dealt = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        part = dealt.groupBy("u", "salt").agg(F.min("v").alias("p"))
        least = part.groupBy("u").agg(F.min("p").alias("m"), F.collect_set("salt").alias("s")).select("u", "m", F.explode("s").alias("salt"))
        return dealt.join(least, ["u", "salt"])

    def large(e):
        both = with_least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).withColumn("m", F.least("m", "u"))
        return both.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e):
        met = with_least(e)
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(met.select("u", F.col("m").alias("v"))).distinct()

    e = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    k, n = 0, e.count()
    while n:
        new = scratch.keep(small(large(e)), f"{name}-{k + 1}")
        same = (m := new.count()) == n and new.join(e, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"{name}-{k}")
        e, k, n = new, k + 1, m
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def group(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id that links reach."""
    scratch = Scratch(df.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(df, doc_id, text, words), "fps")
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comps = scratch.keep(components(links(nodes.select("fp"), distance), scratch), "components")
    rooted = nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(best, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return fps.join(ids, F.col("fp") == F.col("node_fp")).select("doc_id", "fp", "component_id")


def stars(texts: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of ids of (id, text): each fingerprint's least text with its others, and with that of
    the least fingerprint in reach, if that is lesser. So many pairs as texts at most."""
    fps = scratch.keep(fingerprints(texts, "id", "text"), "fps")
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("lead")), "leads")
    centre = links(nodes.select("fp"), distance).groupBy("b").agg(F.min("a").alias("a"))
    lead = lambda c: nodes.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}"))
    apart = centre.join(lead("a"), "a").join(lead("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    equal = fps.join(nodes, "fp").where("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    out = scratch.keep(apart.union(equal), "stars")
    scratch.drop("fps", "leads")
    return out


class Names(dict):
    """64-bit names of words; the memory for them is bounded."""

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = name
        return name


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """64-bit names of the different word shingles, in order; fewer words are one shingle, no words none."""
    cache = worker_cache()
    names = cache.get("names") or cache.setdefault("names", Names())
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(names.__getitem__, w), np.uint64, len(w))
    width, n = min(words, len(w)), max(1, len(w) - words + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _content(text: str):
    """The text, and an empty one for all texts without words."""
    c = F.col(f"`{text}`")
    return F.when(c.rlike("[^ \\t-\\r]"), c).otherwise(F.lit(""))


def _names(content) -> list:
    """128 bits that name a text."""
    return [F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(1), content).alias("k2")]


def _distinct(df: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """(k1, k2, id, words_of, c0, c1 ...): of each different text the row with the smallest doc_id,
    whole, and a number. Copies merge before they travel; the table is bucketed by name, so
    that joins by name move no text."""
    spark, content = df.sparkSession, _content(text)
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("tie"))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
    one = df.select(*_names(content), first.alias("first"), row.alias("row")).groupBy("k1", "k2").agg(F.min_by("row", "first").alias("row"))
    table = f"texts_{uuid.uuid4().hex}"
    numbered = one.select("k1", "k2", F.monotonically_increasing_id().alias("id"), "row.*")
    numbered.write.format("parquet").bucketBy(partitions(spark), "k1", "k2").option("compression", "zstd").option("path", scratch.path("texts")).saveAsTable(table)
    out = spark.table(table)
    scratch.drop()
    spark.sql(f"DROP TABLE {table}")  # its files stay, and the frame knows them
    return out


def _often(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, counts) of the most frequent shingles of a sample of (id, text)."""

    def work(batches):
        for b in sliced(batches, 1):
            for t in texts_of(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(work, "h long").groupBy("h").count().where(F.col("count") >= FEW)
    got = some.orderBy(F.desc("count"), "h").limit(OFTEN).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _rarest(texts: DataFrame, words: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, id, n, r): so many of the rarest shingles h of each text of n that similar texts share
    one; r counts h and all that follow it in the order."""
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def work(batches):
        names, counts = sent.value
        for b in sliced(batches, 1):
            hs, ids, ns, rs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                s = shingle_set(t, words)
                if not len(s):
                    continue
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    s = s[np.argsort(np.where(names[at] == s, counts[at], 0), kind="stable")]
                take = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
                hs.append(s[:take])
                ids.append(np.full(take, i, np.int64))
                ns.append(np.full(take, len(s), np.int32))
                rs.append(np.arange(len(s), len(s) - take, -1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (ids, ns, rs))], ["h", "id", "n", "r"])

    return texts.mapInArrow(work, "h long, id long, n int, r int")


def _sketched(texts: DataFrame, words: int) -> DataFrame:
    """(id, text, sketch): how many of the text's shingles fall into each of SKETCH parts."""

    def work(batches):
        for b in sliced(batches, 1):
            parts = [np.bincount((shingle_set(t, words) >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH).astype("<u4").tobytes() for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.binary())], ["id", "text", "sketch"])

    return texts.select("id", "text").mapInArrow(work, "id long, text string, sketch binary")


def _possible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches allow that similarity: sets share in each part the lesser count at
    most. No similar pair goes, and few others have their texts moved."""

    def work(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(-1, SKETCH).astype(np.int64) for k in (2, 3))
            keep = np.minimum(x, y).sum(axis=1) >= similarity / (1 + similarity) * (x.sum(axis=1) + y.sum(axis=1)) - 1e-6
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    return one.join(texts.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets have at least that Jaccard similarity."""

    def work(batches):
        last, x = None, None
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                a = b.column(0)[k].as_py()
                if a != last:
                    last, x = a, shingle_set(b.column(2)[k].as_py().encode(), words)
                y = shingle_set(b.column(3)[k].as_py().encode(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _reachable(n: str, r: str, m: str, q: str, similarity: float):
    """Can sets of n and m be similar whose first common shingle has r and q from it on? They
    share least(r, q) at most. A pair that can't meets in no bucket as its first common one."""
    need = similarity / (1 + similarity)
    return (F.least(r, q) >= need * (F.col(n) + F.col(m)) - 1e-9) & (F.col(n) >= similarity * F.col(m) - 1e-9) & (F.col(m) >= similarity * F.col(n) - 1e-9)


def _classes(texts: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, root) of the texts (k1, k2, id, text) that are like some other."""
    whole = texts.select("id", "text")
    star = stars(whole, scratch)
    rare = scratch.keep(_rarest(whole, words, similarity, _often(whole, words)), "rare")
    scratch.drop()
    twice = scratch.keep(rare.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "twice")
    scratch.drop()
    met = scratch.keep(rare.join(twice, "h"), "met")
    scratch.drop("rare", "twice")
    # The text that meets most others for its size leads: of a group of copies that is the one they are made from.
    weight = met.groupBy("id").agg((F.sum("c") / F.first("n")).alias("w"))
    rows = scratch.keep(met.join(weight, "id").select("h", "id", "n", "r", "w", F.col("id").alias("to")), "weighed")
    named = texts.select("id", "k1", "k2").join(rows.select("id").distinct(), "id")
    asked = scratch.keep(_sketched(texts.select("k1", "k2", "text").join(named, ["k1", "k2"]), words), "asked")
    scratch.drop()
    edges, compared, k = None, None, 0

    def compare(met, name):
        """Verifies the pairs that have not met before; True if any is similar."""
        nonlocal edges, compared
        new = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = scratch.keep(new.join(compared, ["a", "b"], "left_anti") if compared is not None else new, f"pairs-{name}")
        likely = scratch.keep(_possible(new, asked, similarity), f"possible-{name}")
        good = scratch.keep(_alike(likely, asked, words, similarity), f"similar-{name}")
        scratch.drop(f"possible-{name}")
        edges, compared = (good, new) if edges is None else (edges.union(good), compared.union(new))
        return not good.isEmpty()

    if compare(star, "stars"):
        contracted = scratch.keep(components(edges, scratch, "edges-stars"), "contracted")
        rows = scratch.keep(rows.join(contracted, F.col("id") == F.col("node"), "left").withColumn("to", F.coalesce("root", "to")).drop("node", "root"), "starred")
    while True:
        # Of each bucket: its leader, the component that most of its rows belong to, and how many don't.
        part = rows.groupBy("h", "to").agg(F.count("*").alias("m"), F.max_by(F.struct("id", "n", "r", "to", "w"), F.struct("w", "id")).alias("x"))
        bucket = part.groupBy("h").agg(F.sum("m").alias("m"), F.count("*").alias("parts"), F.max("m").alias("most"), F.max_by("to", "m").alias("main"), F.max_by("x", F.struct("x.w", "x.id")).alias("x")).where("parts > 1")
        bucket = scratch.keep(bucket.select("h", "m", (F.col("m") - F.col("most")).alias("minor"), "main", F.col("x.id").alias("lid"), F.col("x.n").alias("ln"), F.col("x.r").alias("lr"), F.col("x.to").alias("lto")), f"buckets-{k}")
        total, cost = bucket.agg(F.sum("m"), F.sum(F.col("m") * F.col("minor"))).first()
        if not total:
            break
        if k and (cost <= LINEAR * total or not found):
            side = scratch.keep(rows.join(bucket.select("h", "main"), "h").withColumn("minor", F.col("to") != F.col("main")).drop("main"), "side")
            a, b = (side.select(*[F.col(c).alias(f"{c}{x}") for c in side.columns]) for x in "ab")
            met = a.where("minora").join(b, (F.col("ha") == F.col("hb")) & (F.col("toa") != F.col("tob")) & (~F.col("minorb") | (F.col("ida") < F.col("idb"))) & _reachable("na", "ra", "nb", "rb", similarity))
            compare(met.select(F.col("ida").alias("a"), F.col("idb").alias("b")), "last")
            break
        led = rows.join(bucket.select("h", "lid", "ln", "lr", "lto"), "h")
        found = compare(led.where((F.col("to") != F.col("lto")) & _reachable("n", "r", "ln", "lr", similarity)).select(F.col("lid").alias("a"), F.col("id").alias("b")), str(k))
        joined = scratch.keep(components(edges, scratch, f"edges-{k}"), f"joined-{k}") if found else None
        rows = led.where("id != lid").select("h", "id", "n", "r", "w", "to")  # a leader has met all of its bucket
        if found:
            rows = rows.join(joined, F.col("id") == F.col("node"), "left").withColumn("to", F.coalesce("root", "to")).drop("node", "root")
        rows, k = scratch.keep(rows, f"rows-{k}"), k + 1
    scratch.drop("asked", "met", "weighed", "side", "stars", "contracted", "starred", *[f"{x}-{i}" for i in range(k) for x in ("rows", "buckets", "joined")])
    if edges is None:
        return texts.sparkSession.createDataFrame([], "node long, root long")
    return components(edges, scratch, "classes")


def _named_texts(df: DataFrame, doc_id: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(all columns of the different texts, the same as k1, k2, id, doc_id, text)."""
    whole = _distinct(df, doc_id, text, scratch)
    at = {c: F.col(f"c{k}") for k, c in enumerate(df.columns)}
    return whole, whole.select("k1", "k2", "id", at[doc_id].alias("doc_id"), F.coalesce(at[text], F.lit("")).alias("text"))


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest id in the group that links between
    similar texts make, null where no member has one."""
    scratch = Scratch(df.sparkSession, "similar")
    _, texts = _named_texts(df, doc_id, text, scratch)
    classes = scratch.keep(_classes(texts, words, similarity, scratch), "classes")
    rooted = texts.select("k1", "k2", "id", "doc_id").join(classes, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    least = scratch.keep(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    names = rooted.join(least, "root").select("k1", "k2", "component_id")
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), *_names(_content(text))).join(names, ["k1", "k2"]).select("doc_id", "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts: that with the smallest id, then the smallest name
    of its text; one without an id stays only where no member of the group has one. Of rows
    with one text and id, that with the smallest hash of its columns stays."""
    scratch = Scratch(df.sparkSession, "keepers")
    whole, texts = _named_texts(df, doc_id, text, scratch)
    classes = scratch.keep(_classes(texts, words, similarity, scratch), "classes")
    members = scratch.keep(texts.select("k1", "k2", "id", "doc_id").join(classes, F.col("id") == F.col("node")).drop("id", "node"), "members")
    best = scratch.keep(members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("one")), "best")
    gone = members.join(best, "root").where((F.col("k1") != F.col("one.k1")) | (F.col("k2") != F.col("one.k2"))).select("k1", "k2")
    return whole.join(gone, ["k1", "k2"], "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)])


def op6(spark, sf_dir: str) -> DataFrame:
    grouped = group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
