"""Access traces: caches, admission, prefetching, commits. Folds run in order within each cache."""

from collections import OrderedDict

from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.operators.fold import frame, ordered


def prefetch_transitions(accesses: DataFrame) -> DataFrame:
    """The latest successor of every key; repeats of a key are no transition.

    `stream` splits the trace by client, so that ordering never needs one partition."""
    step = accesses.withColumn("next_key", F.lead("key").over(W.partitionBy("stream").orderBy("seq"))).where(F.col("next_key").isNotNull() & (F.col("next_key") != F.col("key")))
    return step.groupBy("stream", "key").agg(F.max_by("next_key", "seq").alias("next_key"), F.count("*").alias("transitions"))


def prefetch_predictions(accesses: DataFrame) -> DataFrame:
    """What was predicted at each access: the key's last known successor before it."""
    w = W.partitionBy("stream").orderBy("seq")
    nxt = accesses.withColumn("next_key", F.lead("key").over(w))
    known = nxt.withColumn("succ", F.when(F.col("next_key") != F.col("key"), F.col("next_key")))
    before = W.partitionBy("stream", "key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return known.select("stream", "seq", "key", F.last("succ", ignorenulls=True).over(before).alias("predicted"), "next_key")


class Lru(OrderedDict):
    """Keys with sizes, the oldest first. get, put and remove are by key, pop takes the oldest."""

    used = 0

    def get(self, key):
        if key not in self:
            return None
        self.move_to_end(key)
        return self[key]

    def put(self, key, size: int) -> None:
        self.used += size - (self.pop(key) if key in self else 0)
        self[key] = size

    def remove(self, key) -> bool:
        if key not in self:
            return False
        self.used -= self.pop(key)
        return True

    def pop_lru(self):
        key, size = self.popitem(last=False)
        self.used -= size
        return key, size


def lru(accesses: DataFrame, capacity: int) -> DataFrame:
    def step(held: Lru, rows):
        hits = []
        for key in rows["key"]:
            hits.append(held.get(key) is not None)
            held.put(key, 1)
            if len(held) > capacity:
                held.pop_lru()
        return frame(rows, ["cache_id", "seq"], hit=hits)

    return ordered(accesses.select("cache_id", "seq", "key"), "cache_id", "seq", Lru, step, "cache_id long, seq long, hit boolean")


def byte_lru(accesses: DataFrame, capacity: int) -> DataFrame:
    """A block larger than the cache is refused; otherwise the oldest go until it fits."""

    def step(held: Lru, rows):
        states, used = [], []
        for key, size in zip(rows["key"], rows["bytes"]):
            states.append("hit" if held.get(key) is not None else "refused" if size > capacity else "miss")
            if states[-1] == "miss":
                while held.used + size > capacity:
                    held.pop_lru()
                held.put(key, size)
            used.append(held.used)
        return frame(rows, ["cache_id", "seq"], outcome=states, used=used)

    return ordered(accesses.select("cache_id", "seq", "key", "bytes"), "cache_id", "seq", Lru, step, "cache_id long, seq long, outcome string, used long")


def admission(ledger: DataFrame, ceiling: int) -> DataFrame:
    """Allocations that would pass the ceiling are refused and change nothing.

    `alloc` and `free` have a size; `resize` and `remap` have an old one besides, and grow by the
    difference or give it back."""
    had = F.col("old_bytes") if "old_bytes" in ledger.columns else F.lit(0)
    moves = ledger.select("ledger", "seq", "op", "bytes", F.coalesce(had, F.lit(0)).cast("long").alias("old"))

    def step(state: dict, rows):
        out = []
        for op, size, old in zip(rows["op"], rows["bytes"], rows["old"]):
            more = -size if op == "free" else size - old
            ok = more <= 0 or state["live"] + more <= ceiling
            state["refused"] += not ok
            state["live"] = max(0, state["live"] + more * ok)
            out.append((ok, state["live"], state["refused"]))
        return frame(rows, ["ledger", "seq"], ok=[x[0] for x in out], live=[x[1] for x in out], refused=[x[2] for x in out])

    return ordered(moves, "ledger", "seq", lambda: {"live": 0, "refused": 0}, step, "ledger long, seq long, ok boolean, live long, refused long")


def cas(attempts: DataFrame) -> DataFrame:
    """Outcome of interleaved commits: one is committed if it expects the object's current
    generation, which is 0 at first and grows by one with each commit."""

    def step(state: dict, rows):
        out = []
        for expected in rows["expected_gen"]:
            ok = expected == state["gen"]
            state["gen"] += ok
            out.append("committed" if ok else "conflict")
        return frame(rows, ["object", "seq", "writer", "expected_gen"], outcome=out)

    return ordered(attempts, "object", "seq", lambda: {"gen": 0}, step, "object string, seq long, writer string, expected_gen long, outcome string")
