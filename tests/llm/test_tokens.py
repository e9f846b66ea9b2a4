import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm import packing, tokenfiles
from tidelog.llm.shared import Scratch
from tidelog.llm.tokens import encoder

ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\na b\n", "don't WE'LL stop", "x y  z", "tab\tbed \x1c q", "É́ é İstanbul ΣΑΣ ß", "1234 12,5", "<|endoftext|> <|startoftext|>",
       "word, word. word; (word) \"word\"", "日本語 テキスト", "😀 🙂🙂", "mixed123 a1b2", "...!!! ???", "᠎ ​ x", "ﬁ ǅ ŉ"]


@pytest.mark.parametrize("kind,file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_same_ids_as_the_library(spark, sf, kind, file):
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rnd = random.Random(2)
    texts += ["".join(rnd.choices("ab é.,'\n 1ſḰsS", k=30)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(encoder(None, kind).ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


SIGNS = ["a", "Zebra", "é", "ß", "İ", "K", "ſ", "ŉ", "ª", "ﬁ", "Σ", "ς", "日本", "😀", "́", "1", "42", "½", ".", ",", "'", "'s", "'LL", "_", "...", "<", "|", "<|", "<|endoftext|>", "<|startoftext|>",
         "<|EndOfText|>", " ", " ", " ", "  ", "\t", "\n", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", "\u180e", "\u200b", "\ufeff", "\0"]


@pytest.mark.parametrize("kind,file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_any_mixture_gives_the_librarys_ids(kind, file):
    plain, mine, rnd = Tokenizer.from_file(public_tokenizers.path(file)), encoder(None, kind), random.Random(9)
    tame = [x for x in SIGNS if not x.strip() in ("", "<|") and x.isprintable()]
    texts = ["".join(rnd.choices(SIGNS, k=rnd.randint(1, 12))) for _ in range(30_000)]
    texts += [rnd.choice([" ", "\n", " ", "  "]).join("".join(rnd.choices(tame, k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6))) for _ in range(30_000)]
    for at in range(0, len(texts), 5000):
        some = texts[at : at + 5000]
        for t, e in zip(some, plain.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(mine.ids(t), "<u4").tolist() == e.ids, repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_crc_combine():
    for n in (1, 4, 333, 70_000):
        a, b = random.Random(n).randbytes(10), random.Random(n + 1).randbytes(n)
        assert tokenfiles.crc_combine(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def rows():
    long = " ".join(random.Random(4).choices(["alpha", "beta,", "gamma"], k=20_000))
    return [(5, "b c"), (5, "b c"), (5, "a"), (None, "no id"), (1, None), (2, ""), (9, long), (-3, "x  y ")]


def test_token_files_round_trip(spark, frame):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    scratch = Scratch(spark, "test")
    tokenfiles.write(frame(rows()), scratch.path("t"), shards=3)
    files = tokenfiles.read(spark, scratch.path("t"))
    got = sorted(tokenfiles.digests(files).collect(), key=lambda r: r.start)
    want = {}
    for i, t in rows():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(ids), crc(ids)))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows()), key=lambda i: (i is not None, i or 0))
    ids = [x for r in files.where("doc_id = 9").orderBy("seg").collect() for x in r.ids]
    assert ids == plain.encode(rows()[6][1], add_special_tokens=False).ids + [0]
    plan = files.where("doc_id = 9")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,9)" in plan
    tokenfiles.write(frame([]), scratch.path("e"))
    assert tokenfiles.digests(tokenfiles.read(spark, scratch.path("e"))).count() == 0


def test_bloom_filters_and_indexes_are_written(spark, frame):
    scratch = Scratch(spark, "test")
    tokenfiles.write(frame([(k, f"text {k}") for k in range(0, 4000, 2)]), scratch.path("t"), shards=1)
    reader = spark._jvm.org.apache.orc.OrcFile
    conf = spark._jsc.hadoopConfiguration()
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch.path("t"))
    file = next(f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().startswith("part-"))
    orc = reader.createReader(file, reader.readerOptions(conf))
    footer = orc.getStripes().get(0)
    assert orc.getRowIndexStride() == 1000 and footer.getIndexLength() > 0


def check_packing(got, docs, capacity):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.setdefault((i, p, at, len(part), crc(part)), 0)
            want[i, p, at, len(part), crc(part)] += 1
    seqs = {}
    for r in got:
        want[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] -= 1
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(want.values())
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing(spark, frame, sf):
    got = packing.pack_documents(frame(rows()), capacity=64, per_task=3).collect()
    check_packing(got, rows(), 64)
    assert packing.pack_documents(frame([])).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = packing.op8(spark, sf).collect()
    n = check_packing(got, docs, 4096)
    assert n <= 1.02 * sum(r.length for r in got) / 4096 + 2


def test_rounds_do_as_well_as_one_task(spark):
    rnd = random.Random(8)
    sizes = [rnd.randint(1, 4096) if rnd.random() < 0.3 else rnd.randint(1, 700) for _ in range(3000)]
    df = spark.createDataFrame([(k, 0, 0, s, k) for k, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = packing.pack(df, Scratch(spark, "test"), per_task=300).select("sequence_id").distinct().count()
    assert n <= 1.02 * len(packing.best_fit(sorted(sizes, reverse=True), 4096)) + 1


def test_best_fit():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
