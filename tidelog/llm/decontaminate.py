"""Benchmark decontamination with suffix arrays over the training words.

Every batch of documents is a shard. Its words become numbers of the tests' vocabulary (0:
in no test, which nothing matches), and a suffix array orders all positions that begin
with a test word, nine words deep. Each test suffix is binary-searched in it; the range it
finds gives all places, and places are followed word by word to the longest match.

The test set goes to the workers in blocks of bounded size, one in memory at a time.

Null and empty texts have no words and no hits; items without words have no window, items
without an id count under the empty string; rows of one id are one item; repeated
documents are judged each by itself; empty tables of either kind give empty or hitless
results; documents of any length are read whole; extra columns are not read.
"""

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.shared import sliced, texts_of

WINDOW, DEPTH, BITS = 8, 3, 21  # three words of 21 bits in each of three sort keys
BLOCK_BYTES, SHARD_WORDS = 8 << 20, 1 << 20
#: Words of a block of tests; a longer item is cut into overlapping pieces, which lose no window.
BLOCK_WORDS = 1 << 20

#: Digits, a-z and all beyond ASCII are words; A-Z are lower-cased; the rest is space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Tests:
    """One block of the test set: vocabulary, item words and their windows, packed for searching."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.items, self.window = [], [], window
        for name, text in rows:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            if w:
                self.names.append(name)
                self.items.append(np.array(w, np.int64))
        spots = [(k, at, min(window, len(w))) for k, w in enumerate(self.items) for at in range(max(1, len(w) - window + 1))]
        self.item = np.array([s[0] for s in spots], np.int64)
        self.at = np.array([s[1] for s in spots], np.int64)
        self.length = np.array([s[2] for s in spots], np.int64)
        flat = np.concatenate([*self.items, np.zeros(9, np.int64)]) if self.items else np.zeros(9, np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(w) for w in self.items]))).astype(np.int64)
        self.flat = flat
        take = (self.first[self.item] + self.at)[:, None] + np.arange(9) if len(spots) else np.zeros((0, 9), np.int64)
        inside = np.arange(9) < self.length[:, None]
        w = flat[np.minimum(take, len(flat) - 1)]
        self.low, self.high = _pack(np.where(inside, w, 0)), _pack(np.where(inside, w, (1 << BITS) - 1))


def _pack(w: np.ndarray) -> list[np.ndarray]:
    """Three keys of three words each, from rows of nine."""
    return [(w[:, k] << (2 * BITS)) | (w[:, k + 1] << BITS) | w[:, k + 2] for k in (0, 3, 6)]


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions that begin with a test word in the order of their nine words, and those words' keys."""
    pos = np.flatnonzero(ids[: len(ids) - 9])
    three = (ids[:-2] << (2 * BITS)) | (ids[1:-1] << BITS) | ids[2:]
    keys = [three[pos], three[pos + 3], three[pos + 6]]
    order = np.lexsort(keys[::-1])
    return pos[order], [k[order] for k in keys]


def search(tests: Tests, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(test window, position) of every occurrence."""
    pos, keys = suffix_array(ids)
    lo = np.searchsorted(keys[0], tests.low[0], "left")
    hi = np.searchsorted(keys[0], tests.high[0], "right")
    which, places = [], []
    for q in np.flatnonzero(hi > lo).tolist():
        a, b = lo[q], hi[q]
        for k in (1, 2):
            if tests.length[q] > 3 * k:
                part = keys[k][a:b]
                a, b = a + np.searchsorted(part, tests.low[k][q], "left"), a + np.searchsorted(part, tests.high[k][q], "right")
            if a >= b:
                break
        if b > a:
            places.append(pos[a:b])
            which.append(np.full(b - a, q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(places)


def longest(tests: Tests, ids: np.ndarray, which: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words of each match when it is followed as far as test and document agree."""
    n = tests.length[which].copy()
    end = np.array([len(w) for w in tests.items], np.int64)[tests.item[which]] - tests.at[which] if len(which) else n
    base = tests.first[tests.item[which]] + tests.at[which] if len(which) else n
    open_ = np.flatnonzero(n < end)
    while len(open_):
        same = ids[places[open_] + n[open_]] == tests.flat[base[open_] + n[open_]]
        open_ = open_[same]
        n[open_] += 1
        open_ = open_[n[open_] < end[open_]]
    return n


def blocks_of(benchmark: DataFrame, item_id: str, text: str, window: int) -> list:
    """The test set as broadcasts, each made from at most about BLOCK_BYTES of text and BLOCK_WORDS
    words; repeated rows count once."""
    spark = benchmark.sparkSession
    b = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).distinct()
    total = b.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_BYTES))
    out = []
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        held, size = [], 0
        for name, piece, words_in in _pieces(sorted((r["name"], r["text"].encode()) for r in part.collect()), window):
            if held and size + words_in > BLOCK_WORDS:
                out.append(spark.sparkContext.broadcast(Tests(held, window)))
                held, size = [], 0
            held.append((name, piece))
            size += words_in
        out.append(spark.sparkContext.broadcast(Tests(held, window)))
    return out


def _pieces(rows: list[tuple[str, bytes]], window: int):
    """(name, text, words) of items, the longest cut so that each window is in one piece."""
    for name, text in rows:
        w = words(text)
        for k in range(0, max(1, len(w) - window + 1), BLOCK_WORDS // 2):
            part = w[k : k + BLOCK_WORDS // 2 + window - 1]
            yield name, b" ".join(part), len(part)


def _shards(texts: list[list[bytes]]):
    """Runs of documents of about SHARD_WORDS words."""
    first = n = 0
    for k, w in enumerate(texts):
        if n and n + len(w) > SHARD_WORDS:
            yield first, k
            first, n = k, 0
        n += len(w)
    if first < len(texts):
        yield first, len(texts)


def _judge(texts: list[list[bytes]], blocks: list, visit) -> None:
    """visit(block, first document, positions' starts, ids, windows, places) for every shard and block."""
    for block in blocks:
        tests = block.value
        get = tests.vocabulary.get
        for a, b in _shards(texts):
            starts = np.concatenate(([0], np.cumsum([len(w) + 9 for w in texts[a:b]]))).astype(np.int64)
            ids = np.zeros(starts[-1] + 9, np.int64)
            for k in range(a, b):
                s = starts[k - a]
                ids[s : s + len(texts[k])] = np.fromiter(map(get, texts[k], repeat(0)), np.int64, len(texts[k]))
            visit(tests, a, starts, ids, *search(tests, ids))
        if len(blocks) > 1 and hasattr(block, "_value"):
            del block._value


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, least_items: int = 2, keep: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match.

    With keep, all columns of docs come instead, of the documents that aren't contaminated."""
    if not 1 <= window <= 8:
        raise ValueError("windows have 1 to 8 words")
    blocks = blocks_of(benchmark, item_id, item_text, window)
    names = docs.columns

    def work(batches):
        for b in sliced(batches, len(names) if keep else 1):
            texts = [words(t) for t in texts_of(b.column(len(names) if keep else 1))]
            n = len(texts)
            covered = [np.zeros(len(w) + 1, np.int32) for w in texts]
            items: list[set] = [set() for _ in range(n)]
            most = np.zeros(n, np.int64)

            def visit(tests, a, starts, ids, which, places):
                if not len(which):
                    return
                doc = np.searchsorted(starts, places, "right") - 1
                far = longest(tests, ids, which, places)
                np.maximum.at(most, doc + a, far)
                pairs = np.unique(np.stack([doc, tests.item[which]]), axis=1)
                for d, i in pairs.T.tolist():
                    items[d + a].add(tests.names[i])
                order = np.argsort(doc, kind="stable")
                cuts = np.flatnonzero(np.diff(doc[order])) + 1
                for part in np.split(order, cuts):
                    d = int(doc[part[0]])
                    c = covered[d + a]
                    np.add.at(c, places[part] - starts[d], 1)
                    np.add.at(c, places[part] - starts[d] + tests.length[which[part]], -1)

            _judge(texts, blocks, visit)
            bad = [len(x) >= least_items for x in items]
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array([not x for x in bad])) for k in range(len(names))], names)
                continue
            hit = [int((np.cumsum(c[:-1]) > 0).sum()) if x else 0 for c, x in zip(covered, items)]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array(bad), pa.array(most)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"])

    if keep:
        src = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_scanned"))
        return src.mapInArrow(work, docs.schema)
    key = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, f"doc_id {key}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, item_pos, doc_id, doc_pos, words) of every match that can't be made longer on either side."""
    blocks = blocks_of(benchmark, item_id, item_text, window)
    key = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        for b in sliced(batches, 1):
            texts = [words(t) for t in texts_of(b.column(1))]
            out: list[list] = [[], [], [], [], []]

            def visit(tests, a, starts, ids, which, places):
                before = np.where(tests.at[which] > 0, tests.flat[tests.first[tests.item[which]] + tests.at[which] - 1], -1) if len(which) else which
                maximal = np.flatnonzero((places == 0) | (ids[places - 1] != before)) if len(which) else which
                which, places = which[maximal], places[maximal]
                doc = np.searchsorted(starts, places, "right") - 1
                for c, v in zip(out, ([tests.names[i] for i in tests.item[which]], tests.at[which].tolist(), (doc + a).tolist(), (places - starts[doc]).tolist(), longest(tests, ids, which, places).tolist())):
                    c.extend(v)

            _judge(texts, blocks, visit)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), b.column(0).take(pa.array(out[2], pa.int64())), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], ["item_id", "item_pos", "doc_id", "doc_pos", "words"])

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, f"item_id string, item_pos long, doc_id {key}, doc_pos long, words long")


def op4(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
