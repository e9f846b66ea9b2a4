import hashlib
import random
from collections import Counter

from tidelog.llm import repeats


def brute(docs, n=200):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[a : a + n] for _, t in texts for a in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - n + 1):
            if seen[t[a : a + n]] > 1:
                gone[a : a + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, frame):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(k) for k in (20, 45, 50, 60, 120)]
    docs = [(k, text(rnd.randint(0, 120))) for k in range(25)]
    for k in range(40):
        p = rnd.choice(passage)
        cut = rnd.randint(0, len(p) // 3)
        docs.append((100 + k, text(rnd.randint(0, 40)) + p[cut:] + text(rnd.randint(0, 40))))
    for k in range(20):
        t = list(docs[rnd.randrange(65)][1])
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = "#"
        docs.append((200 + k, "".join(t)))
    docs += [(300, None), (301, ""), (302, "a" * 199), (303, "a" * 200), (304, "a" * 201), (305, "ab" * 400), (306, "x" + "ab" * 101), (307, "abc" * 66 + "ab"), (308, "abcdefg" * 60), (309, "hijklmn" * 30), (310, ("qwertyuiop" * 9 + "\n") * 3)]
    docs += [(400, docs[3][1]), (400, docs[3][1]), (3, docs[3][1]), (None, docs[70][1]), (None, text(60)), (500, text(9000) + passage[3] + text(3000))]
    got = sorted((tuple(r) for r in repeats.remove(frame(docs)).collect()), key=repr)
    assert got == brute(docs)
    assert repeats.remove(frame([])).count() == 0


def test_small_chunks_give_the_same(spark, frame, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rnd = random.Random(2)
    base = ["".join(rnd.choices("ab", k=rnd.randint(150, 900))) for _ in range(12)]
    docs = [(k, rnd.choice(base)[: rnd.randint(100, 900)]) for k in range(30)]
    assert sorted((tuple(r) for r in repeats.remove(frame(docs)).collect()), key=repr) == brute(docs)


def test_rows_without_ids_and_repeated_rows(spark, frame):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("ab", k=rnd.randint(150, 900))) for _ in range(12)]
    docs = [(k, rnd.choice(base)[: rnd.randint(100, 900)]) for k in range(30)] + [(None, base[0]), (3, base[1]), (40, None)]
    assert sorted((tuple(r) for r in repeats.remove(frame(docs)).collect()), key=repr) == brute(docs)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in repeats.op5(spark, sf).collect()), key=repr) == brute(docs)
