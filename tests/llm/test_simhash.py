import random

import xxhash

from tidelog.llm import simhash
from tidelog.llm.shared import Scratch


def brute_fp(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        best[r] = i if best.get(r) is None else (best[r] if i is None else min(best[r], i))
    return sorted(((i, fps[k], best[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def test_groups_match_brute_force(spark, frame):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for k in range(60)]
    for k in range(40):
        w = rows[rnd.randrange(60)][1].split()
        if w:
            w[rnd.randrange(len(w))] = "new"
        rows.append((100 + k, " ".join(w) + " "))
    long = " ".join(rnd.choices(words, k=60_000))
    rows += [(300, long), (301, long + " z"), (302, None), (303, ""), (304, "Ab c"), (304, "aB  C"), (None, "ab c"), (305, "É\x0bé"), (306, rows[0][1]), (306, rows[0][1])]
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.group(frame(rows)).collect()), key=repr)
    assert got == brute_groups(rows)
    assert simhash.group(frame([])).count() == 0


def test_links_are_all_pairs_in_reach(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << p for p in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == want and want


def test_long_chain_is_one_component(spark):
    n = 500
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([tuple(sorted((order[k], order[k + 1]))) for k in range(n - 1)], "a long, b long")
    got = simhash.components(edges, Scratch(spark, "test")).collect()
    assert len(got) == n and {r.root for r in got} == {0}


def test_whole_table(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op6(spark, sf).collect()), key=repr)
    assert got == brute_groups(texts)


def brute_similar(rows, words=5, least=0.8):
    """Group number of every row: texts are linked where their shingle sets are similar."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            low, high = sorted((len(x), len(y)))
            if x == y or (low >= least * high and len(x & y) >= least * len(x | y)):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def brute_keepers(rows):
    """Ids that stay: the smallest of each group; none stays only where no member has an id."""
    best = {}
    for (i, _), r in zip(rows, brute_similar(rows)):
        best[r] = i if best.get(r) is None else (best[r] if i is None else min(best[r], i))
    return sorted(best.values(), key=repr)


def copies(rnd, n, length):
    """Texts and copies of them with words changed all over or a passage changed at one place."""
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(*length)))) for k in range(n)]
    for k in range(2 * n):
        w = rows[rnd.randrange(n)][1].split()
        if rnd.random() < 0.5:
            for _ in range(rnd.randint(0, len(w) // 60)):
                w[rnd.randrange(len(w))] = "new"
        else:
            at = rnd.randrange(len(w))
            w[at : at + len(w) // rnd.randint(8, 16)] = rnd.choices(vocabulary, k=len(w) // 12)
        rows.append((1000 + k, " ".join(w)))
    return rows


def test_near_copies_are_found(spark, frame):
    rows = copies(random.Random(7), 100, (60, 400))
    want = len(brute_keepers(rows))
    got = [r.doc_id for r in simhash.deduplicate(frame(rows)).collect()]
    assert len(got) == len(set(got)) and set(brute_keepers(rows)) <= set(got)  # nothing beyond copies goes
    assert len(rows) - len(got) >= 0.98 * (len(rows) - want)


def test_one_of_each_group_stays(spark, frame):
    base = copies(random.Random(8), 4, (100, 200))[:4]
    long = " ".join(f"l{k % 9973}" for k in range(60_000))
    rows = base + [(10, base[0][1].upper()), (11, base[1][1] + " end"), (12, long), (13, long + " z"), (20, None), (21, ""), (22, " \n\x0b"), (23, "a b"), (24, "a  b"), (25, "a c"), (26, "one two three four five six"), (26, "seven"), (26, "seven"), (26, "eight"), (None, "nine"), (None, "nine"), (None, "ten"), (None, base[2][1])]
    got = simhash.deduplicate(frame(rows))
    assert sorted((r.doc_id for r in got.collect()), key=repr) == brute_keepers(rows)
    assert got.schema == frame(rows).schema and simhash.deduplicate(frame([])).count() == 0


def test_known_pairs_need_no_second_look(spark, frame):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(0, 300, 2)]  # one group, pairs near and far
    assert [r.doc_id for r in simhash.deduplicate(frame(rows)).collect()] == [0]


def test_stage_keeps_what_brute_force_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted((r.doc_id for r in simhash.deduplicate(docs).collect()), key=repr) == brute_keepers([(r.doc_id, r.text) for r in docs.collect()])


def test_lines_repeated_in_one_copy(spark, frame):
    rnd = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):
        lines = [" ".join(rnd.choices(vocabulary, k=12)) for _ in range(10)]
        rows += [(k, "\n".join(lines)), (100 + k, "\n".join(lines + [lines[-1]] * 30))]
    want = brute_keepers(rows)
    assert len(want) == 60
    assert sorted((r.doc_id for r in simhash.deduplicate(frame(rows)).collect()), key=repr) == want


def test_pairs_at_the_limit_are_all_found(spark, frame):
    rnd = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(150):
        n = rnd.choice([4, 4, 5, 8, 12, 60])  # shingles; the copy has a quarter more
        w = rnd.choices(vocabulary, k=n + 4 + n // 4)
        rows += [(k, " ".join(w[: n + 4])), (1000 + k, " ".join(w))]
    want = brute_keepers(rows)
    assert len(want) == 150
    assert sorted((r.doc_id for r in simhash.deduplicate(frame(rows)).collect()), key=repr) == want


def test_near_copies_go_through_fingerprints_and_stars(spark, frame, monkeypatch):
    rows = copies(random.Random(17), 40, (60, 400))
    rows += [(5000 + k, t.replace(" ", "  ")) for k, t in rows[:10]]  # other texts, equal fingerprints
    texts = spark.createDataFrame(rows, "id long, text string")
    fp = {i: brute_fp(t) for i, t in rows}
    fp = {i: f - (1 << 64) if f >> 63 else f for i, f in fp.items()}
    lead = {f: min(i for i in fp if fp[i] == f) for f in fp.values()}
    near = lambda f: [g for g in lead if g < f and bin((f ^ g) & (2**64 - 1)).count("1") <= 4]
    apart = {(lead[min(near(f))], lead[f]) for f in lead if near(f)}
    want = apart | {(lead[f], i) for i, f in fp.items() if i != lead[f]}
    stars = simhash.stars
    got = {tuple(r) for r in stars(texts, Scratch(spark, "test")).collect()}
    assert got == want and len(apart) >= 10
    met = []
    monkeypatch.setattr(simhash, "stars", lambda *a: met.append(stars(*a)) or met[-1])
    assert sorted((r.doc_id for r in simhash.deduplicate(frame(rows)).collect()), key=repr) == brute_keepers(rows)
    assert len(met) == 1
