"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings. Column expressions only.

Whatever runs along a text (places of matches, windows of a candidate, spans to merge) is
folded in blocks of bounded size, whose results are strung together: time grows with the
text's length, however many matches it holds and however long one candidate is.

Null and empty texts have no spans; a text of any length is read whole; ties (spans that
start together) keep the order assign, access, hex, entropy; repeated rows are judged
each by itself; an empty table gives an empty result; other columns pass through, and the
added one is the caller's choice of name.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

# The three pattern kinds in their order, each with its group and least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
ORDER = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a window must reach, by the narrowest class that holds the whole candidate. Of uniformly
#: random windows 3.0, 0.7 and 0.5 % stay below.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"^", 3.6)]
#: Candidates that are no secrets: without a digit or without a letter, words joined by
#: dashes, underscores or slashes, UUID-like ids, and placeholders.
ALLOW = [r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/+=]+(?:[A-Za-z]+|[0-9]{1,4}))*+[-_/+=]*$", r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"(?i)example|sample|placeholder"]

SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"
#: Elements of a list, and windows of a candidate, that one fold takes.
BLOCK, WINDOWS = 256, 512
#: A candidate's characters are codes 43 to 122; a count of 0 to WINDOW takes 5 bits, and 12 counts a long.
FIRST, BITS, EACH, LONGS = 43, 5, 12, 7


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once, whatever its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column, of: int = BLOCK) -> Column:
    """A list cut into lists of `of` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / of).cast("int")), lambda k: F.slice(items, k * of + 1, F.lit(of)))


def _walk(items: Column, state: Column, step, kind: str) -> Column:
    """The lists that step(state, item) -> (state, list) gives along a list, strung together.

    Only blocks' results are appended to blocks' results, so that no long list is copied for each item."""
    empty, none = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(a, x):
        after, made = step(a["state"], x)
        return F.struct(after.alias("state"), F.concat(a["out"], made).alias("out"))

    def block(a, xs):
        got = F.aggregate(xs, F.struct(a["state"].alias("state"), empty.alias("out")), one)
        return _bound(got, lambda g: F.struct(g["state"].alias("state"), F.concat(a["out"], F.array(g["out"])).alias("out")))

    return _bound(items, lambda all_: F.aggregate(_blocks(all_), F.struct(state.alias("state"), none.alias("out")), block, lambda a: F.flatten(a["out"])))


def _located(text: Column, pattern: str) -> Column:
    """(start, found) of every leftmost match: the texts between matches give the offsets."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "struct<start:bigint,found:string>"

    def step(at, p):
        begin = at + F.coalesce(F.length(p["gap"]), F.lit(0))
        hit = F.when(p["found"].isNotNull(), F.array(F.struct(begin.alias("start"), p["found"].alias("found")))).otherwise(F.expr(f"cast(array() as array<{kind}>)"))
        return (begin + F.coalesce(F.length(p["found"]), F.lit(0))).cast("bigint"), hit

    return _walk(F.arrays_zip(gaps.alias("gap"), found.alias("found")), F.lit(0).cast("bigint"), step, kind)


def _span(start: Column, stop: Column, kind: str) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(ORDER.index(kind)).alias("rank"), stop.cast("bigint").alias("stop"), F.lit(kind).alias("kind"))


def _base(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind; a short match is dropped after it has taken its characters."""
    kept = lambda x: F.length(F.regexp_extract(x["found"], pattern, group)) >= least
    return F.transform(F.filter(_located(text, pattern), kept), lambda x: _span(x["start"], x["start"] + F.length(x["found"]), kind))


def _stretches(block: Column, bits: Column) -> Column:
    """(start, stop) within a block of a candidate of what its high-entropy windows cover.

    Counts of the window's characters are kept in a few longs. A step takes one character out
    of its count and one into its count, and adds what that changes in the sum of c * log2(c);
    no window is counted anew. A stretch is written when a window no longer touches it."""
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    kind = "array<struct<start:int,stop:int>>"
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"c{k}") for k in range(LONGS)], F.lit(0.0).alias("total"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.expr(f"cast(array() as {kind})").alias("out"))

    def count(a, at):
        held = F.lit(0).cast("bigint")
        for k in range(LONGS):
            held = F.when(F.floor(at / EACH) == k, a[f"c{k}"]).otherwise(held)
        return F.call_function("shiftright", held, (at % EACH * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def moved(a, at, by):
        one = F.call_function("shiftleft", F.lit(by).cast("bigint"), (at % EACH * BITS).cast("int"))
        return F.struct(*[F.when(F.floor(at / EACH) == k, a[f"c{k}"] + one).otherwise(a[f"c{k}"]).alias(f"c{k}") for k in range(LONGS)])

    weight = lambda w, c: F.element_at(w, c + 1)

    def run(codes, w):
        def step(a, i):
            def left(x):  # x: the counts after a character went out, and the sum
                came = F.element_at(codes, i)

                def after(n):
                    total = x["total"] + weight(w, n + 1) - weight(w, n)
                    high = (i >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= bits - 1e-9)
                    touches = a["stop"] >= i - WINDOW
                    return F.struct(
                        moved(x["c"], came, 1).alias("c"), total.alias("total"),
                        F.when(high & ~touches, i - WINDOW).otherwise(a["start"]).alias("start"), F.when(high, i).otherwise(a["stop"]).alias("stop"),
                        F.when(high & ~touches & (a["stop"] >= 0), F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))).otherwise(a["out"]).alias("out"))

                return _bound(_bound(count(x["c"], came), after), lambda r: F.struct(*[r["c"][f"c{k}"].alias(f"c{k}") for k in range(LONGS)], *[r[n].alias(n) for n in ("total", "start", "stop", "out")]))

            kept = F.struct(*[a[f"c{k}"].alias(f"c{k}") for k in range(LONGS)])
            went = F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))
            out = _bound(count(a, went), lambda n: F.struct(moved(a, went, -1).alias("c"), (a["total"] + weight(w, n - 1) - weight(w, n)).alias("total")))
            return _bound(F.when(i > WINDOW, out).otherwise(F.struct(kept.alias("c"), a["total"].alias("total"))), left)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda a: F.when(a["stop"] >= 0, F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))).otherwise(a["out"]))

    codes = F.transform(F.split(block, ""), lambda c: F.ascii(c) - FIRST)
    return _bound(F.struct(codes.alias("codes"), weights.alias("w")), lambda v: run(v["codes"], v["w"]))


def _windows(found: Column) -> Column:
    """(start, stop) within a candidate of the stretches that high-entropy windows cover.

    Blocks overlap by a window less one character; stretches of neighbouring blocks that touch
    become one."""
    bits = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        bits = F.when(found.rlike(pattern), F.lit(least)).otherwise(bits)
    kind = "struct<start:int,stop:int>"

    def of(v):
        # Bytes are cut in constant time; a candidate is ASCII.
        part = lambda k: F.substring(v["bytes"], k * WINDOWS + 1, F.lit(WINDOWS + WINDOW - 1)).cast("string")
        last = F.floor((F.octet_length(v["bytes"]) - WINDOW) / WINDOWS).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: F.transform(_stretches(part(k), v["bits"]), lambda x: F.struct((x["start"] + k * WINDOWS).alias("start"), (x["stop"] + k * WINDOWS).alias("stop")))))

    def merge(a, x):
        apart = x["start"] > a["stop"]
        done = F.when(apart & (a["stop"] >= 0), F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop")))).otherwise(F.expr(f"cast(array() as array<{kind}>)"))
        return F.struct(F.when(apart, x["start"]).otherwise(a["start"]).alias("start"), F.greatest(a["stop"], x["stop"]).alias("stop")), done

    spans = _bound(F.struct(found.cast("binary").alias("bytes"), bits.alias("bits")), of)
    # A last span that touches nothing lets go of the one before it.
    end = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("stop")))
    return _walk(F.concat(spans, end), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop")), merge, kind)


def _entropy(text: Column) -> Column:
    allowed = lambda x: F.lit(False)
    for pattern in ALLOW:
        allowed = (lambda f, p: lambda x: f(x) | x["found"].rlike(p))(allowed, pattern)
    kept = F.filter(_located(text, CANDIDATE), lambda x: ~allowed(x))
    return F.flatten(F.transform(kept, lambda x: F.transform(_windows(x["found"]), lambda w: _span(x["start"] + w["start"], x["start"] + w["stop"], "entropy"))))


#: Cheap tests that come before the costly expressions; each holds for every text with a match.
_FIRST = {
    "assign": lambda t: (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(BASE[0][1]),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "hex": lambda t: t.rlike(BASE[2][1]),
}


def find_secrets(df: DataFrame, text: str = "text", to: str = "spans", entropy: bool = True) -> DataFrame:
    """Adds all spans as structs of code-point offsets, by start and then by kind.

    A high-entropy stretch inside a pattern's span adds nothing and is left out."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = [F.when(_FIRST[b[0]](t), _base(t, *b)).otherwise(_none()) for b in BASE]
    base = F.concat(*parts)
    if not entropy:
        return df.withColumn(to, F.array_sort(base))
    more = F.when(t.rlike(CANDIDATE), _entropy(t)).otherwise(_none())
    both = df.withColumn(to, F.struct(base.alias("b"), more.alias("m")))
    b, m = F.col(to)["b"], F.col(to)["m"]
    return both.withColumn(to, F.when(F.size(m) > 0, _fresh(b, m)).when(F.size(b) > 0, F.array_sort(b)).otherwise(_none()))


def _fresh(base: Column, more: Column) -> Column:
    """All spans in order, without those of `more` that lie inside one of `base`.

    Spans are walked by falling length from each start on; whatever lies inside a base span
    then comes after it, and the furthest stop so far decides."""
    kind = SPAN[len("array<") : -1]
    key = lambda own: lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), F.lit(own).alias("own"), x["rank"].alias("rank"), x["kind"].alias("kind"))
    walked = F.array_sort(F.concat(F.transform(base, key(0)), F.transform(more, key(1))))

    def step(far, x):
        inside = (x["own"] == 1) & (far >= -x["back"])
        span = F.struct(x["start"].alias("start"), x["rank"].alias("rank"), (-x["back"]).alias("stop"), x["kind"].alias("kind"))
        return F.when(x["own"] == 0, F.greatest(far, -x["back"])).otherwise(far), F.when(inside, _none()).otherwise(F.array(span))

    return F.array_sort(_walk(walked, F.lit(-1).cast("bigint"), step, kind))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def redact(df: DataFrame, text: str, spans: str, mask: str = "[SECRET]") -> DataFrame:
    """The text with each stretch that spans cover replaced by the mask; spans are in order.

    Four bytes a character let each kept piece be cut in constant time."""
    t = F.coalesce(F.col(text), F.lit(""))

    def step(wide):
        def one(at, x):
            gap = F.decode(F.substring(wide, (at * 4 + 1).cast("int"), ((x["start"] - at) * 4).cast("int")), "UTF-32")
            piece = F.when(x["start"] >= at, F.array(gap, F.lit(mask))).otherwise(F.expr("cast(array() as array<string>)"))
            return F.greatest(at, x["stop"]), F.when(x["stop"] > at, piece).otherwise(F.expr("cast(array() as array<string>)"))

        return one

    def whole(v):
        end = F.struct(*[x.alias(n) for n, x in zip(("start", "rank", "stop", "kind"), (F.octet_length(v["wide"]).cast("bigint") / 4, F.lit(0), F.lit(2**40), F.lit("")))]).cast(SPAN[len("array<") : -1])
        pieces = _walk(F.concat(v["spans"], F.array(end)), F.lit(0).cast("bigint"), step(v["wide"]), "string")
        return _bound(pieces, lambda p: F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ""))

    masked = _bound(F.struct(F.encode(t, "UTF-32").alias("wide"), F.col(spans).alias("spans")), whole)
    return df.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text)))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
