"""HTML extraction: bodies under any name, reader comments, nesting, and template counts against a plain count."""

import random
import time
from collections import Counter, defaultdict

import pytest

from lexiflow.llm import html

PAGES = "page_id long, url string, html string, host string, texts int, gone int, nr int, subtree int"


def extract(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "h", 1, 2, 3, 4) for r in rows], PAGES).repartition(3)
    got = html.extract(df, **kw).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.url, r.text) for r in got), key=str)


@pytest.mark.parametrize("comments", [
    "<section class='comments-area'><h2>Comments</h2><article class='comment-body'>reader</article></section>",
    "<ol class='comment-list'><li>reader<article>x</article></li></ol>", "<div id=comments><article>reader</article></div>",
    "<ul class=commentlist><li class='comment odd'>reader</ul>", "<div class='comment_thread'><p>reader</div>"])
def test_reader_comments_are_no_body(comments):
    assert html.main_text(f"<p>real body</p>{comments}") == "real body"
    assert html.main_text(f"<article><p>real body</p>{comments}</article>") == "real body"
    assert html.main_text(f"<article class='post no-comments'><p>real body</p></article>{comments}") == "real body"


@pytest.mark.parametrize("name", ["div class='widget'", "div class='post related'", "section class='notice'"])
def test_bodies_under_weak_names_stay(name):
    long = " ".join(["real words"] * 300)
    box = f"<{name}><p>{long}</p></{name.split()[0]}>"
    assert html.main_text(box) == long and html.main_text("<div>small</div>" + box) == f"small {long}"
    assert html.main_text(f"<p>{long} {long}</p><{name}>a box</{name.split()[0]}>") == f"{long} {long}"


def test_items_inside_an_article_stay():
    assert html.main_text("<article><ul><li class='menu'>a dish</li></ul><p class='social'>short</p></article>") == "a dish short"
    assert html.main_text("<article>text<div class='menu'><a>one</a> <a>two</a></div></article>") == "text"


def test_nesting_is_linear():
    at = time.process_time()
    assert html.main_text("<b>" * 20000 + "</i>" * 20000 + "text") == "text"
    assert html.main_text("<p>" + "<b>" * 20000 + "<div>x</div>" * 9000) == " ".join(["x"] * 9000)
    assert time.process_time() - at < 10


def plain_templates(rows, min_pages=html.MIN_PAGES):
    """Recurring subtrees by a plain count over distinct pages."""
    pages = defaultdict(set)
    for _, url, page in rows:
        pages[url.split("/")[2].lower() if url and "://" in url else ""].add(page or "")
    out = {}
    for host, held in pages.items():
        n = Counter(h for p in held for h in {s[0] for s in html.parse(p).subtrees})
        size = len(held)
        enough = max(3, -(-size // 2)) if size < 2 * min_pages else max(min_pages, -(-size * 2 // 100))
        out[host] = frozenset(h for h, c in n.items() if c >= enough)
    return out


def test_templates_equal_a_plain_count(spark):
    rnd = random.Random(4)
    boxes = [f"<div class=b{i}>box {i}<span>s{i % 3}</span></div>" for i in range(12)]
    rows = []
    for i in range(400):
        host = rnd.choice(["a.example", "B.example", "c.example", "c.example", "c.example"])
        body = "".join(rnd.sample(boxes, rnd.randint(0, 5))) + f"<div>own {rnd.randint(0, 300)}</div>" + rnd.choice(["", "<article><p>text</p><div class=z>zz</div></article>"])
        rows.append((i, rnd.choice([f"http://{host}/{i}", f"https://{host}:1/{i}"]), body))
    rows += [(500, None, boxes[0]), (501, "no url", None), (502, "", ""), *rows[:3]]
    t = plain_templates([(i, u, p) for i, u, p in rows])
    want = sorted(((i, u, html.main_text(p, t[u.split("/")[2].lower() if u and "://" in u else ""])) for i, u, p in rows), key=str)
    assert extract(spark, rows) == want
    assert any(t.values())


def test_an_article_at_ten_addresses_of_a_large_host_stays(spark):
    rows = [(i, f"http://big.example/{i}", f"<div class=t>template</div><div class=c>page {i if i >= 10 else 'shared'}</div><div>{i}</div>") for i in range(600)]
    got = {i: t for i, _, t in extract(spark, rows)}
    assert got[3] == "page shared 3" and got[77] == "page 77 77"


def test_no_pages(spark):
    assert extract(spark, []) == []
