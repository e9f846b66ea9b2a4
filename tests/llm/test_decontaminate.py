import hashlib
import random
import re

from tidelog.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=8):
    out = []
    split = lambda t: WORD.findall((t or "").encode().lower())
    wins = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[a : a + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    for d, t in docs:
        w = split(t)
        hit, names = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    names |= wins[tuple(w[a : a + n])]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, frame):
    rnd = random.Random(1)
    vocab = [f"w{k}" for k in range(12)] + ["É", "x_y"]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(k, text(rnd.choice([0, 1, 3, 5, 7, 8, 9, 20, 40]))) for k in range(25)] + [(None, text(12)), (7, text(10)), (7, text(10)), (30, None)]
    docs = [(k, text(rnd.randint(0, 60))) for k in range(60)]
    docs += [(100 + k, text(10) + " " + (items[rnd.randrange(25)][1] or "") + ", " + text(5)) for k in range(30)]
    docs += [(200, None), (201, ""), (202, "!!!"), (None, items[8][1]), (0, docs[0][1]), (300, text(300_00) + items[5][1].upper())]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r)[:6] for r in decontaminate.scan(frame(docs), bench).collect()), key=repr)
    assert got == brute(docs, items)
    few = [(k, text(9)) for k in range(6)]
    one = spark.createDataFrame(few, "item_id long, text string")
    kept = decontaminate.scan(frame(docs), one, keep=True)
    assert kept.columns == frame([]).columns
    bad = sum(x[5] for x in brute(docs, few))
    assert kept.count() == len(docs) - bad
    assert decontaminate.scan(frame([]), bench).count() == 0
    none = decontaminate.scan(frame(docs[:5]), bench.where("false")).collect()
    assert len(none) == 5 and not any(r.n_hit for r in none)


def test_several_blocks_give_the_same(spark, frame, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choices("abcdefgh", k=n))
    items, docs = [(k, text(9)) for k in range(30)], [(k, text(400)) for k in range(30)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    got = sorted((tuple(r)[:6] for r in decontaminate.scan(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == brute(docs, items)


def test_longest_matches_and_places(spark, frame):
    item = [f"t{k}" for k in range(20)]
    docs = [(1, "a b " + " ".join(item[3:15]) + " c"), (2, " ".join(item)), (3, " ".join(item[:7]))]
    got = {tuple(r) for r in decontaminate.matches(frame(docs), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {("5", 3, 1, 2, 12), ("5", 0, 2, 0, 20)}


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r)[:6] for r in decontaminate.op4(spark, sf).collect()), key=repr)
    assert got == brute(docs, items)


def test_one_very_long_item_is_cut_without_loss(frame, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    w = [f"w{k}" for k in range(150)]
    items = [("long", " ".join(w)), ("long", " ".join(w)), ("short", "a b c"), ("eight", " ".join(w[20:28]))]
    docs = [(k, " ".join(["x", *w[k : k + 8], "y"])) for k in range(0, 143)] + [(200, " ".join(w)), (201, "z a b c z"), (202, None)]
    got = decontaminate.scan(frame(docs), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == sorted((d, n, h, len(i)) for d, n, h, i in counted(docs, items))


def counted(docs, items, window=8):
    """(doc_id, words, hit words, items) by looking for each window everywhere."""
    for d, t in docs:
        w, hit, found = (t or "").split(), set(), set()
        for name, text in items:
            v = text.split()
            for k in range(max(1, len(v) - window + 1)):
                part = v[k : k + window]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        found.add(name)
        yield d, len(w), len(hit), found
