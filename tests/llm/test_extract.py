import html
import random
import re

import pytest

import time

from tidelog.llm import extract


@pytest.fixture(scope="module")
def model():
    return extract.train()


def test_held_out_pages(model):
    rnd = random.Random(99)
    right = n = 0
    for _ in range(150):
        page, y = extract.training_page(rnd)
        got = model.decode(extract.blocks(page))
        right += sum(a == b for a, b in zip(got, y))
        n += len(y)
    assert right >= 0.97 * n


def test_blocks():
    page = "<p>a&amp;b <b>c</b>d\n e<p>f&nbsp;<i>g</i><br>h<div>i</div>j<script>x</p></script>&am"
    assert [x[1] for x in extract.blocks(page)] == ["a&b cd e", "f g", "h", "i", "j&am"]


def test_whole_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    got = extract.op3(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        body = re.sub(r"</?(?:p|h1|br|article)\b[^>]*>", " ", body)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())
        assert r.text == want and r.n_chars == len(want)


def test_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (2, None, "<p>"), (None, "u", "plain words without any markup at all."), (4, "u", "<article>" + "<p>some words in a row.</p>" * 5000)]
    got = extract.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id in (1, 2)] == ["", "", ""]
    assert next(r for r in got if r.page_id == 4).text == " ".join(["some words in a row."] * 5000)
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ARTICLE = "<article><h1>A title of some words</h1><p>Some words of the text, and some more of them in a row.</p></article>"


@pytest.mark.parametrize("before", [
    '<svg class="icon"/>', '<SVG viewBox="0 0 1 1" />', '<svg class="icon"/><p class="menu">x <svg><path d="M0"/><text>icon</text></svg></p>', "<svg>", "<option>", "<select><option>one<option>two</select>",
    '<datalist id="d"><option value="a"></datalist>', '<datalist><option value="a">one<option>two</datalist>', '<datalist><option value="a">', "<select><option>one</option>", "<option>one</option>",
])
@pytest.mark.parametrize("after", ["", "<footer><select><option>three</option></select><svg><text>icon</text></svg></footer>"])
def test_article_after_open_elements(model, before, after):
    page = f"<html><body><header>{before}</header>{ARTICLE}{after}</body></html>"
    texts = [x[1] for x in extract.blocks(page)]
    want = ["A title of some words", "Some words of the text, and some more of them in a row."]
    assert texts[-2:] == want and "icon" not in " ".join(texts)
    assert " ".join(want) in model.main_text(page)


def test_unclosed_quotes_leave_no_markup():
    for page in ('<p class="x>hello there</p>', "<p class='x>hello there</p><a href='/y'></a>", '<div id="a><p>hello there</p>'):
        assert "".join(x[1] for x in extract.blocks(page)) == "hello there", page
    assert [x[1] for x in extract.blocks('<p title="a > b">one</p><p>two</p>')] == ["one", "two"]


def test_depth_costs_no_more_than_length():
    def took(n):
        start = time.time()
        got = extract.blocks("".join(f'<div class="c"><span>t{k}</i>' for k in range(n)))
        assert len(got) == n
        return time.time() - start

    took(1000)
    assert took(40_000) < 40 * max(took(4_000), 0.05)
