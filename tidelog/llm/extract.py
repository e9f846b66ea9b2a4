"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is read by a small tolerant tokenizer into blocks of text, each with its open tags.
Features of the ancestors (tags, and the words of their class, id and role) and of the text
(length, links, signs) weigh two labels, and transitions link neighbours. The weights are
fitted by gradient ascent of the likelihood on labelled pages, which a generator of page
layouts writes (TRAIN of them); pages are decoded by Viterbi.

A null or empty page, and one without text, gives an empty text; unclosed tags and quotes (a tag
then ends with its first >), any depth of open elements, cut-off
references and very long pages are read whole; repeated pages and ids are judged each by
itself; an empty table gives an empty result; extra columns are not read.
"""

import html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.shared import sliced

TRAIN, ROUNDS, RATE = 600, 80, 0.5
# Elements without content, with raw content, those of them that end with their tag
# where no end tag follows before a scope's tag or one of their kind, those that stand in no path, and those that don't end a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript textarea title svg iframe select datalist".split())
BRIEF = frozenset("svg select datalist".split())
LOOSE = frozenset(["option"])
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SCOPES = frozenset("article main nav aside footer header form section".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*/?>|[^<>]*>)|<[!?][^>]*>", re.S)
_SCOPE_TAG = rf"</?(?:{'|'.join(sorted(SCOPES))})\b"
_ATTR = re.compile(r"""(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Za-z]+")
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Open:
    """An open element. What features need of those above it is carried along, so that depth costs nothing."""

    __slots__ = ("tag", "path")

    def __init__(self, tag: str, marks: str, above: tuple):
        self.tag = tag
        own = [f"in:{tag}", *[f"mark:{w}" for w in _WORDS.findall(marks)]]
        known, scope, leaf, _ = above
        new = tuple(x for x in dict.fromkeys(own) if x not in known)
        self.path = (known + new if new else known, (tag, marks) if tag in SCOPES or (marks and tag != "body") else scope, tag, leaf)


_TOP = ((), None, None, None)


def blocks(page: str) -> list[tuple[tuple, str, int]]:
    """(what the open elements are, text, characters inside links) of every leaf block."""
    out, stack, paths, text, linked, at = [], [], [_TOP], [], 0, 0
    held = Counter()  # open elements by tag

    def close():
        nonlocal text, linked
        got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if got:
            out.append((paths[-1], got, linked))
        text, linked = [], 0

    def leave(k):
        for x in stack[k:]:
            held[x.tag] -= 1
            if x.tag not in INLINE:
                paths.pop()
        del stack[k:]

    for m in _MARKUP.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
            if held["a"]:
                linked += m.start() - at
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                close()
            if held[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            if tag == "svg" and m[0].endswith("/>"):
                continue
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag in BRIEF and (not end or re.compile(rf"<{tag}\b|{_SCOPE_TAG}", re.I).search(page, at, end.start())):
                continue
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            close()
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    leave(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag not in VOID and tag not in LOOSE:
            marks = " ".join(a or b or c for _, a, b, c in _ATTR.findall(m[3])).lower() if m[3] else ""
            one = Open(tag, marks, paths[-1])
            stack.append(one)
            held[tag] += 1
            if tag not in INLINE:
                paths.append(one.path)
    if at < len(page):
        text.append(page[at:])
    close()
    return out


@lru_cache(200_000)
def _path_features(path: tuple) -> tuple[str, ...]:
    known, scope, leaf, above = path
    f = list(known)
    if scope:
        f += [f"scope:{scope[0]}", *[f"near:{w}" for w in _WORDS.findall(scope[1])]]
    if leaf:
        f.append(f"leaf:{leaf}")
        if above:
            f.append(f"pair:{above}>{leaf}")
    return tuple(dict.fromkeys(f))


def features(path: tuple, text: str, linked: int) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    f = ["bias", f"long:{min(6, n.bit_length() // 2)}", f"words:{min(5, words.bit_length())}"]
    if linked * 2 > n:
        f.append("linked")
    if text[-1] in ".!?":
        f.append("ends")
    if "©" in text:
        f.append("sign")
    return [*_path_features(path), *f]


class Model:
    """Weights of known features, transitions and their index; two labels, 1 being main text."""

    def __init__(self, names: dict[str, int], w: np.ndarray, t: np.ndarray):
        self.names, self.w, self.t = names, w, t

    def decode(self, page: list[tuple[tuple, str, int]]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        get, w = self.names.get, self.w
        t00, t01, t10, t11 = self.t.ravel().tolist()
        back, a, b = [], 0.0, 0.0
        for k, x in enumerate(page):
            at = [i for i in map(get, features(*x)) if i is not None]
            e0, e1 = w[at].sum(axis=0).tolist()
            if not k:
                a, b = e0, e1
                continue
            p0, p1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
            back.append((p0, p1))
            a, b = e0 + (b + t10 if p0 else a + t00), e1 + (b + t11 if p1 else a + t01)
        y = [int(b > a)]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]

    def main_text(self, page: str | None) -> str:
        got = blocks(page or "")
        return " ".join(x[1] for x, y in zip(got, self.decode(got)) if y)


def fit(pages: list[tuple[list, list[int]]], rounds: int = ROUNDS, rate: float = RATE, ridge: float = 1e-3) -> Model:
    """Gradient ascent (with per-weight steps) of the conditional likelihood over all pages at once."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in features(*x)] for x in blocks_] for blocks_, _ in pages]
    m, longest, n = len(pages), max(len(r) for r in rows), len(names)
    page = np.array([p for p, r in enumerate(rows) for x in r for _ in x])
    spot = np.array([k for r in rows for k, x in enumerate(r) for _ in x])
    feat = np.array([i for r in rows for x in r for i in x])
    mask = np.zeros((m, longest), bool)
    gold = np.zeros((m, longest), np.int64)
    for p, (_, y) in enumerate(pages):
        mask[p, : len(y)], gold[p, : len(y)] = True, y
    w, t = np.zeros((n, 2)), np.zeros((2, 2))
    gw, gt = np.full((n, 2), 1e-8), np.full((2, 2), 1e-8)
    truth = np.eye(2)[gold] * mask[:, :, None]
    both = mask[:, 1:, None, None] & mask[:, :-1, None, None]
    pairs_true = (truth[:, :-1, :, None] * truth[:, 1:, None, :] * both).sum((0, 1))
    lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
    for _ in range(rounds):
        e = np.zeros((m, longest, 2))
        np.add.at(e, (page, spot), w[feat])
        f, g = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for k in range(1, longest):
            f[:, k] = np.where(mask[:, k, None], e[:, k] + lse(f[:, k - 1, :, None] + t, 1), f[:, k - 1])
        for k in range(longest - 2, -1, -1):
            g[:, k] = np.where(mask[:, k + 1, None], lse(t + (e[:, k + 1] + g[:, k + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        node = np.exp(np.minimum(f + g - z[:, None, None], 0)) * mask[:, :, None]
        edge = np.exp(np.minimum(f[:, :-1, :, None] + t + (e[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * both
        diff = truth - node
        dw = np.zeros((n, 2))
        np.add.at(dw, feat, diff[page, spot])
        dw -= ridge * w * m
        dt = pairs_true - edge.sum((0, 1)) - ridge * t * m
        gw, gt = gw + dw**2, gt + dt**2
        w, t = w + rate * dw / np.sqrt(gw), t + rate * dt / np.sqrt(gt)
    return Model(names, w, t)


# What layouts call their parts, in several habits of markup.
_OUTER = {
    "nav": (["<nav{}>", "<div{}>", "<ul{}>", "<header{}>"], ["nav", "navbar", "menu", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "navigation", "toc", "pagination", "skip-link"]),
    "header": (["<header{}>", "<div{}>"], ["header", "site-header", "masthead", "banner", "top-bar", "branding", "logo"]),
    "footer": (["<footer{}>", "<div{}>"], ["footer", "site-footer", "copyright", "legal", "bottom"]),
    "side": (["<aside{}>", "<div{}>", "<section{}>"], ["sidebar", "aside", "widget", "related", "related-posts", "trending", "recommended", "rail", "popular", "share", "social", "tags", "author-bio"]),
    "ad": (["<div{}>", "<aside{}>", "<section{}>", "<p{}>"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor"]),
    "notice": (["<div{}>", "<section{}>", "<p{}>"], ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "subscribe", "paywall", "disclaimer"]),
    "form": (["<form{}>", "<div{}>", "<fieldset{}>"], ["search", "form", "login", "newsletter", "signup", "search-form", "contact"]),
    "comment": (["<section{}>", "<div{}>", "<ol{}>"], ["comments", "comment", "comment-list", "reply", "responses", "discussion", "disqus"]),
}
_MAIN = ["<article{}>", "<main{}>", "<div{}>", "<section{}>", "<div role=\"main\"{}>"]
_MAIN_MARKS = ["article", "content", "post", "entry-content", "main-content", "story", "article-body", "post-body", "text", "body"]


def training_page(rnd: random.Random) -> tuple[str, list[int]]:
    """A page of some layout and the label of each of its blocks."""
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstuvéèüñß", k=rnd.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    out: list[str] = []
    spans: list[tuple[str, int]] = []

    def put(tag, text, y, inner=False):
        key = f"k{len(spans)}z"
        spans.append((key, y))
        body = f"<a href=\"/x\">{key} {text}</a>" if inner else f"{key} {text}"
        out.append(f"<{tag}>{body}</{tag}>" if tag else body)

    def wrap(opening, mark):
        attr = rnd.choice([f' class="{mark}"', f' id="{mark}"', f' class="x {mark} y"', f' class="{mark}" id="{word()}"'])
        out.append(opening.format(attr if rnd.random() < 0.9 or opening.startswith(("<div", "<p", "<section", "<ul", "<ol")) else ""))
        return "</" + re.match(r"<(\w+)", opening)[1] + ">"

    def part(kind):
        openings, marks = _OUTER[kind]
        opening = rnd.choice(openings)
        end = wrap(opening, rnd.choice(marks))
        if kind in ("nav", "side") and rnd.random() < 0.7 and not opening.startswith("<p"):
            bare = opening.startswith(("<ul", "<ol"))
            out.append("" if bare else "<ul>")
            for _ in range(rnd.randint(2, 8)):
                put("li", words(1, 5), 0, inner=rnd.random() < 0.9)
            out.append("" if bare else "</ul>")
        elif opening.startswith("<p"):
            put("", words(3, 25), 0)
        elif kind == "comment":
            for _ in range(rnd.randint(1, 6)):
                if rnd.random() < 0.5:
                    put(rnd.choice(["h4", "span", "div"]), words(1, 3), 0)
                    out.append("<br>")
                put(rnd.choice(["p", "li", "div"]), words(3, 60) + ".", 0)
        else:
            for _ in range(rnd.randint(1, 3)):
                put(rnd.choice(["p", "div", "h3", ""]), words(1, 30) + rnd.choice(["", ".", " ©", "!"]), 0, inner=rnd.random() < 0.3)
                out.append("<br>")
        out.append(end)

    out.append(f'<!DOCTYPE html><html lang="en"><head><title>{words(3, 8)}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>')
    for kind in rnd.sample(["header", "nav", "ad", "notice", "form", "side"], rnd.randint(1, 5)):
        part(kind)
    outer = rnd.random() < 0.3
    if outer:
        out.append(rnd.choice(['<div id="page">', '<div class="container">', '<div class="wrapper">']))
    end = wrap(rnd.choice(_MAIN), rnd.choice(_MAIN_MARKS))
    put(rnd.choice(["h1", "h1", "h2"]), words(3, 12), 1)
    for _ in range(rnd.randint(1, 12)):
        x = rnd.random()
        if x < 0.7:
            text = words(*rnd.choice([(1, 2), (1, 5), (3, 12), (10, 120), (30, 200)]))
            text = rnd.choice([text] * 6 + [text.replace(" ", " | "), text.replace(" ", "*** "), text.upper().replace(" ", "!! "), text.replace(" ", "; ")])
            put("p", text + rnd.choice([".", ".", "", "?", " |"]), 1)
        elif x < 0.76:
            put(rnd.choice(["h2", "h3", "blockquote", "pre", "figcaption", "td"]), words(2, 30), 1)
        elif x < 0.82:
            out.append("<ul>")
            for _ in range(rnd.randint(1, 4)):
                put("li", words(2, 20), 1, inner=rnd.random() < 0.1)
            out.append("</ul>")
        elif x < 0.88:
            out.append("<p><b>")
            put("", words(2, 40), 1)
            out.append("<br>")
        elif x < 0.93:
            put("div", words(1, 60), 1)
        else:
            part(rnd.choice(["ad", "side", "notice", "form"]))
    if rnd.random() < 0.15:
        part("comment")
    out.append(end)
    if outer:
        out.append("</div>")
    for kind in rnd.sample(["footer", "comment", "side", "ad", "nav", "form", "notice"], rnd.randint(1, 5)):
        part(kind)
    out.append("</body></html>" if rnd.random() < 0.9 else "")
    label = dict(spans)
    page = "".join(out)
    y = [label[re.search(r"k\d+z", text)[0]] for _, text, _ in blocks(page)]
    return page, y


def train(pages: int = TRAIN, seed: int = 11) -> Model:
    rnd = random.Random(seed)
    made = [training_page(rnd) for _ in range(pages)]
    return fit([(blocks(p), y) for p, y in made if y])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or train())

    def work(batches):
        m = sent.value
        for b in sliced(batches, 2):
            texts = [m.main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html")).mapInArrow(work, f"page_id {kind(page_id)}, url {kind(url)}, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
