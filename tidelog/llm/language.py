"""Language identification: text likelihoods fused with declared language, address suffix and host priors.

The text model is naive Bayes over hashed character trigrams, fitted on a bounded sample
of rows with a declared language (SAMPLE rows a language, of FIT_CHARS characters at
most; longer ones are left out of the fit, never cut). Scores of a text are averaged and weighted like WEIGHT
trigrams, since trigrams of one text aren't independent. Priors of hosts are counts of all
rows by host, smoothed towards those of their address suffix, and these towards the whole;
a row's own declaration doesn't count in its host's prior.

Languages are those that at least SUPPORT rows declare, MOST_LANGUAGES at most; all else is
"other", whose trigrams are all equally likely, and is not accepted.

A null or empty text, or one without letters, has no evidence of its own and is rejected;
null declarations, suffixes and hosts say nothing; ties go to the first language in order;
repeated rows are judged alike; an empty table gives an empty result; texts are read
whole; with keep, all columns pass through under their own names.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.shared import Scratch, sliced

SAMPLE, FIT_CHARS, BUCKETS, WEIGHT = 1500, 20_000, 1 << 16, 60
TRUST, HOST_PULL, SUFFIX_PULL, LEAST = 0.9, 20.0, 50.0, 0.5
SUPPORT, MOST_LANGUAGES, OTHER = 3, 200, "other"


def _letters() -> np.ndarray:
    """Lower-cased letters below U+0250 as themselves, all else there as a space."""
    out = np.full(0x250, 32, np.uint32)
    for k in range(0x250):
        if chr(k).isalpha():
            low = chr(k).lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def trigrams(text: str, table: np.ndarray) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 0x250, table[np.minimum(c, 0x24F)], c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = np.concatenate((np.array([32], np.uint32), c[keep], np.array([32], np.uint32))).astype(np.uint64)
    if not (c != 32).any():
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64)


def languages_of(rows: DataFrame) -> list[str]:
    """What at least SUPPORT rows declare, in order; the most frequent MOST_LANGUAGES of them."""
    n = rows.where("declared IS NOT NULL").groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    return sorted(r["declared"] for r in n.orderBy(F.desc("n"), "declared").limit(MOST_LANGUAGES).collect())


def fit(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log likelihoods of (bucket, language), the last column being any other, centred on their mean."""
    usable = rows.where(F.col("declared").isin(languages) & F.length("text").between(40, FIT_CHARS))
    n = dict(usable.groupBy("declared").count().collect())
    share = F.lit(0.0)
    for k, v in n.items():
        share = F.when(F.col("declared") == k, min(1.0, SAMPLE / v)).otherwise(share)
    picked = usable.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * SAMPLE * max(1, len(languages)))
    table, counts = _letters(), np.full((BUCKETS, len(languages)), 0.05)
    for r in picked.select("declared", "text").collect():
        np.add.at(counts[:, languages.index(r["declared"])], trigrams(r["text"], table), 1)
    logs = np.log(counts / counts.sum(axis=0)) if languages else counts
    seen = counts.sum(axis=0) > 0.06 * BUCKETS
    if seen.any():
        logs[:, ~seen] = logs[:, seen].min(axis=1, keepdims=True)  # a language without rows wins no text
    else:
        logs[:] = -np.log(BUCKETS)
    logs = np.hstack([logs, np.full((BUCKETS, 1), -np.log(BUCKETS))])
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def priors(rows: DataFrame, languages: list[str], suffixes: bool = True) -> tuple[DataFrame, list[float]]:
    """(suffix, host, n, mid): rows of each host by language, any other last, and what they are
    smoothed towards; and the shares in all rows together.

    Rows are counted by suffix and host in one grouped aggregation; suffixes and the whole are sums of its rows."""
    known = F.col("declared").isin(languages) if languages else F.lit(False)
    n = [F.count(F.when(F.col("declared") == v, 1)).cast("double").alias(f"n{k}") for k, v in enumerate(languages)]
    n.append(F.count(F.when(F.col("declared").isNotNull() & ~known, 1)).cast("double").alias(f"n{len(languages)}"))
    hosts = rows.groupBy(F.coalesce("suffix", F.lit("")).alias("suffix"), F.coalesce("host", F.lit("")).alias("host")).agg(*n)
    ks = range(len(n))
    by_suffix = hosts.groupBy("suffix").agg(*[F.sum(f"n{k}").alias(f"m{k}") for k in ks])
    top = by_suffix.agg(*[F.sum(f"m{k}") for k in ks]).first()
    total = sum(x or 0.0 for x in top)
    whole = [((x or 0.0) + 1) / (total + len(n)) for x in top]
    size = sum((F.col(f"m{k}") for k in ks), F.lit(0.0))
    if not suffixes:  # one suffix for all: the whole is all there is to smooth towards
        return hosts.select("suffix", "host", F.array(*[f"n{k}" for k in ks]).alias("n"), F.array(*[F.lit(w) for w in whole]).alias("mid")), whole
    mid = by_suffix.select("suffix", F.array(*[(F.col(f"m{k}") + SUFFIX_PULL * w) / (size + SUFFIX_PULL) for k, w in enumerate(whole)]).alias("mid"))
    return hosts.select("suffix", "host", F.array(*[f"n{k}" for k in ks]).alias("n")).join(mid, "suffix"), whole


def host_prior(n, mid, own: int | None) -> np.ndarray:
    """Log prior of a row at a host, its own declaration left out."""
    n = np.array(n)
    if own is not None:
        n[own] = max(0.0, n[own] - 1)
    return np.log((n + HOST_PULL * np.array(mid)) / (n.sum() + HOST_PULL))


def identify(df: DataFrame, text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, languages: tuple[str, ...] | None = None, keep: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns with lang_id, confidence and accepted; with keep, the accepted rows as they came.

    Without `languages`, the declared ones are taken. Priors go to the rows by a join that Spark
    broadcasts only while they are small; else it deals both by host and splits hot hosts."""
    spark = df.sparkSession
    scratch = Scratch(spark, "language")
    col = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    said = F.nullif(F.lower(F.substring(F.trim(col(declared)), 1, 2)), F.lit(""))
    evidence = df.select(F.coalesce(col(text), F.lit("")).alias("text"), said.alias("declared"), F.lower(col(suffix)).alias("suffix"), F.lower(col(host)).alias("host"))
    langs = languages_of(evidence) if languages is None else sorted(languages)
    model = fit(evidence, langs)
    by_host, whole = priors(evidence, langs, suffix is not None)
    by_host = scratch.keep(by_host, "priors")
    passed = df.columns if keep else list(carry)
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(passed)], F.coalesce(col(text), F.lit("")).alias("_text"), said.alias("_declared"),
        F.coalesce(F.lower(col(suffix)), F.lit("")).alias("_suffix"), F.coalesce(F.lower(col(host)), F.lit("")).alias("_host"))
    by_host = by_host.select(F.col("suffix").alias("_s"), F.col("host").alias("_h"), F.col("n").alias("_n"), F.col("mid").alias("_mid"))
    met = rows.join(by_host, (F.col("_suffix") == F.col("_s")) & (F.col("_host") == F.col("_h")), "left").drop("_s", "_h", "_suffix", "_host")
    sure, unsure = math.log(TRUST), math.log((1 - TRUST) / max(1, len(langs)))
    sent, n = spark.sparkContext.broadcast(model), len(passed)
    names = [f.name for f in df.schema] if keep else [*carry, "lang_id", "confidence", "accepted"]

    def work(batches):
        table, logs = _letters(), sent.value
        at, classes = {x: k for k, x in enumerate(langs)}, [*langs, OTHER]
        base, spread = np.log(whole), np.arange(len(classes))
        for b in sliced(batches, n):
            best, conf, ok = [], [], []
            for t, d, c, m in zip(*(b.column(n + k).to_pylist() for k in range(4))):
                g = trigrams(t, table)
                own = None if d is None else at.get(d, len(langs))
                score = base.copy() if c is None else host_prior(c, m, own)
                if len(g):
                    score = score + logs[g].sum(axis=0, dtype=np.float64) * (min(len(g), WEIGHT) / len(g))
                if own is not None:
                    score = score + np.where(spread == own, sure, unsure)
                e = np.exp(score - score.max())
                e /= e.sum()
                k = int(e.argmax())
                best.append(classes[k])
                conf.append(float(e[k]))
                ok.append(bool(len(g)) and k < len(langs) and conf[-1] >= LEAST)
            cols = [b.column(k) for k in range(n)]
            if keep:
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in cols], [f"c{k}" for k in range(n)])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(best, pa.string()), pa.array(conf, pa.float64()), pa.array(ok, pa.bool_())], [*[f"c{k}" for k in range(n)], "lang_id", "confidence", "accepted"])

    fields = ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(passed))
    out = met.mapInArrow(work, fields if keep else f"{fields}, lang_id string, confidence double, accepted boolean".lstrip(", "))
    return out.toDF(*names)


def from_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, declared, suffix, host) of raw pages, by expressions."""
    html = F.coalesce("html", F.lit(""))
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return pages.select(
        "page_id", "url",
        F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[#A-Za-z0-9]+;", " ").alias("text"),
        F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2})""", 1), F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), host.alias("host"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, "text", declared="lang", host="source", carry=("doc_id", "lang", "source"))


def langid_pages(spark, sf_dir: str) -> DataFrame:
    return identify(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), "text", "declared", "suffix", "host", carry=("page_id", "url", "declared"))
