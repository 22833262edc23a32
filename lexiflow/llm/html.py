"""Main-text extraction by removal of site templates.

Every element subtree that holds readable text is hashed (tag, class, texts, child
hashes). Spark counts, per host, the distinct pages that hold a subtree; a subtree on
many of the host's pages is the site's template and is deleted: on ``FEWEST`` pages and
half of the host's pages where these are fewer than 20, on ``min_pages`` and ``SHARE`` of
them on larger hosts, on none on hosts of one or two pages. Paragraphs, headings, lists and
tables inside an article are never taken for template: a site may print one passage twice.

What the elements' names alone rule out (scripts, styles, navigation, forms, reader comments) is
left out when a page is read; the remaining texts are short segments with the subtrees as ranges
of segments. The subtrees are written and counted without texts. A second reading gives the
segments, which alone meet the deleted ranges; html is never shuffled.

The main part is what article and main elements hold, if any text is left in them; else it
is the rest of the page. Articles in dropped parts are no main part; articles marked as
comments or related pages are read only where the page has nothing else.

Class names, ids and roles count as whole names. ``ADVERTS`` are deleted. ``STRUCTURE`` is deleted
outside the main part, inside it only where it is mostly links. ``WEAK`` names are deleted where they
are mostly links, else only where the page has at least as much other text: a body is not lost for
its container's name. Reader comments are containers named comment, comments or respond, or whose
name starts so (comment-list, comments-area); an element that holds an article or main is never deleted.

Defined results: null html is empty and gives an empty text; unclosed and cut-off
markup is read to its end; copies of one page count once in the template counts;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import materialize

MIN_PAGES = 10
FEWEST = 3
SHARE = 0.02
SALTS = 16             # parts that a subtree's pages are spread over
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title "
                   "tr ul").split())
DROPPED = frozenset(("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas "
                     "dialog menu").split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option"}
KEEPS_P = frozenset("div article section td body li main aside blockquote".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tbody tr td th figure figcaption".split())
ADVERTS = frozenset("ad ads advert adverts advertisement cookie cookies consent modal newsletter popup promo sponsor sponsored subscribe".split())
STRUCTURE = frozenset("banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation sidebar".split())
WEAK = frozenset("notice notices related share sharing social widget".split())
COMMENTS = ("comment", "comments", "respond")
CONTAINERS = frozenset("article div section ol ul li".split())
MAIN, SOFT, ASIDE = 1, 2, 4       # a segment's flags: in the main part, under a weak name, in an article of comments or related pages


def _commenting(name: str) -> bool:
    return any(name == c or name.startswith((c + "-", c + "_")) for c in COMMENTS) or name == "commentlist"


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("tag", "state", "first", "main", "dropped", "chars", "linked", "names", "commenting", "holds", "link", "within")

    def __init__(self, tag, state, first, main, dropped, names, commenting, link, within):
        self.tag, self.state, self.first, self.main, self.dropped, self.names = tag, state, first, main, dropped, names
        self.commenting, self.link, self.within = commenting, link, within
        self.chars = self.linked = 0
        self.holds = False


class _Reader(HTMLParser):
    """Pieces of text in page order, and elements as ranges of pieces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text = []        # (text or None for a block boundary, in main part, dropped)
        self.subtrees = []    # (hash, first piece, end piece)
        self.stack: list[_Open] = []
        self.open = {}        # open elements by tag
        self.gone = []        # (first, end) of what names delete
        self.soft = []        # the same for weak names
        self.aside = []       # the same for articles of comments or related pages

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.open.get("p"):
            self._close("p", KEEPS_P)
        up = self.stack[-1] if self.stack else None
        main = up.main if up else False
        if tag in BLOCK:
            self.text.append((None, main, False))
        if tag in VOID:
            return
        a = dict(attrs)
        label = f"{a.get('class') or ''} {a.get('id') or ''} {a.get('role') or ''}".lower().split() if tag not in ("html", "body", "main") else ()
        names = {n for n in label if n in ADVERTS or n in STRUCTURE or n in WEAK}
        commenting = tag in CONTAINERS and any(map(_commenting, label))
        main = main or tag == "main" or (tag == "article" and not commenting and "related" not in names)
        dropped = (up.dropped if up else False) or tag in DROPPED or (tag == "header" and not main) or "hidden" in a
        state = xxhash.xxh64(f"<{tag} {a.get('class') or ''}>".encode("utf-8", "replace"))
        within = bool(up and (up.within or up.commenting))
        self.stack.append(_Open(tag, state, len(self.text), main, dropped, names, commenting, tag == "a" or bool(up and up.link), within))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_data(self, data):
        if not self.stack:
            self.text.append((data, False, False))
            return
        e = self.stack[-1]
        self.text.append((data, e.main, e.dropped))
        words = " ".join(data.split())
        e.state.update(words.encode("utf-8", "replace"))
        e.chars += len(words)
        if e.link:
            e.linked += len(words)

    def _pop(self):
        e = self.stack.pop()
        self.open[e.tag] -= 1
        end = len(self.text)
        if self.stack:
            up = self.stack[-1]
            up.state.update(e.state.digest())
            up.chars += e.chars
            up.linked += e.linked
            up.holds |= e.holds or (e.tag in ("article", "main") and e.main and not e.dropped and e.chars > 0)
        if e.chars and not e.dropped and e.tag not in ("html", "body", "article", "main") and not (e.main and (e.tag in TEXTUAL or e.tag not in BLOCK)):
            self.subtrees.append((e.state.intdigest() - (1 << 63), e.first, end))
        if (e.commenting or e.names) and not e.holds:
            links = 2 * e.linked > e.chars
            if e.tag == "article" and (e.commenting or "related" in e.names):
                (self.gone if e.within else self.aside).append((e.first, end))
            elif e.commenting or not e.names.isdisjoint(ADVERTS) or links or (not e.main and not e.names.isdisjoint(STRUCTURE)):
                self.gone.append((e.first, end))
            elif not e.main:
                self.soft.append((e.first, end))
        elif e.commenting and e.tag != "article":
            self.gone.append((e.first, end))          # a container of comments may hold them as articles
        if e.tag in BLOCK:
            self.text.append((None, e.main, False))

    def _close(self, tag, stop=frozenset()):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in stop:
                return

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self._close(tag)
        elif tag == "p" and self.stack:
            self.text.append((None, self.stack[-1].main, False))


def _inside(ranges, n: int) -> list[bool]:
    """Which of n pieces are in one of the ranges."""
    step = [0] * (n + 1)
    for a, z in ranges:
        step[a] += 1
        step[z] -= 1
    out, depth = [], 0
    for s in step[:n]:
        depth += s
        out.append(depth > 0)
    return out


class Page:
    """What is left of a page to choose from: ``texts`` with their ``blocks`` and ``flags``, and the ``subtrees`` as
    (hash, first text, end text)."""

    def __init__(self, html: str | None):
        r = _Reader()
        r.feed(html or "")
        r.close()
        while r.stack:
            r._pop()
        n = len(r.text)
        gone, soft, aside = (_inside(x, n) for x in (r.gone, r.soft, r.aside))
        cuts = {x for s in r.subtrees for x in s[1:]}
        self.texts, self.blocks, self.flags, starts = [], [], [], []
        block, joined, last = 0, False, 0
        for i, (data, main, dropped) in enumerate(r.text):
            if data is None:
                block += 1
                joined = False
                continue
            if dropped or gone[i]:
                joined = joined and i not in cuts
                continue
            flags = MAIN * main | SOFT * soft[i] | ASIDE * aside[i]
            if joined and i not in cuts and not any(c in cuts for c in range(last + 1, i)) and flags == self.flags[-1]:
                self.texts[-1] += data
            else:
                self.texts.append(data)
                self.blocks.append(block)
                self.flags.append(flags)
                starts.append(i)
            joined, last = True, i
        self.texts = [_narrow(t) for t in self.texts]
        ranges = ((h, bisect_left(starts, a), bisect_left(starts, z)) for h, a, z in r.subtrees)
        self.subtrees = [s for s in ranges if s[1] < s[2]]


def _narrow(text: str) -> str:
    """White space runs as one space, at the ends too."""
    inner = " ".join(text.split())
    if not inner:
        return " " if text else ""
    return " " * text[0].isspace() + inner + " " * text[-1].isspace()


def parse(html: str | None) -> Page:
    return Page(html)


def choose(texts, blocks, flags, gone) -> str:
    """The main text of a page without the texts in the ``gone`` ranges."""
    cut = _inside(gone, len(texts))
    alive = [i for i in range(len(texts)) if not cut[i]]

    def size(part):
        return sum(len(texts[i].strip()) for i in part)

    plain = [i for i in alive if not flags[i] & (SOFT | ASIDE)]
    soft = [i for i in alive if flags[i] & SOFT and not flags[i] & ASIDE]
    mains = [i for i in plain if flags[i] & MAIN]
    if size(mains):
        kept = mains
    elif size(soft) > size(plain):
        kept = [i for i in alive if not flags[i] & ASIDE]
    else:
        kept = plain
    if not size(kept):
        kept = alive
    out: list[str] = []
    block = None
    for i in kept:
        if blocks[i] == block:
            out[-1] += texts[i]
        else:
            out.append(texts[i])
            block = blocks[i]
    return " ".join(x for x in (" ".join(b.split()) for b in out) if x)


def main_text(html: str | None, template=frozenset()) -> str:
    """Main text of one page; ``template`` holds the subtree hashes to delete."""
    page = Page(html)
    return choose(page.texts, page.blocks, page.flags, [s[1:] for s in page.subtrees if s[0] in template])


_KEY = ["host", "k1", "k2"]      # copies of a page (same host, same html) share one key
_OUTLINE = "host long, k1 long, k2 long, subtrees array<long>, firsts array<int>, ends array<int>"
_SEGMENTS = "page_id long, url string, host long, k1 long, k2 long, texts array<string>, blocks array<int>, flags array<int>"
_ARROW = {"page_id": pa.int64(), "url": pa.string(), "host": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "texts": pa.list_(pa.string()),
          "blocks": pa.list_(pa.int32()), "flags": pa.list_(pa.int32()), "subtrees": pa.list_(pa.int64()), "firsts": pa.list_(pa.int32()),
          "ends": pa.list_(pa.int32())}


def _parsed(pages: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` of every page: its name, host and content key, segments, or subtrees as ranges of segments."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = {c: [] for c in names if c not in b.schema.names}
            for html in b.column("html"):
                html = html.as_py() or ""
                page = Page(html)
                k = xxhash.xxh3_128_intdigest(html.encode("utf-8", "replace"))
                found = {"k1": (k >> 64) - (1 << 63), "k2": (k & (1 << 64) - 1) - (1 << 63), "texts": page.texts, "blocks": page.blocks,
                         "flags": page.flags, "subtrees": [s[0] for s in page.subtrees], "firsts": [s[1] for s in page.subtrees],
                         "ends": [s[2] for s in page.subtrees]}
                for c, values in out.items():
                    values.append(found[c])
            yield pa.RecordBatch.from_arrays([pa.array(out[c], _ARROW[c]) if c in out else b.column(c) for c in names], names)

    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    own = [F.col("page_id").cast("long").alias("page_id"), "url"] if "page_id" in names else []
    return pages.select(*own, F.xxhash64(host).alias("host"), "html").mapInArrow(run, schema)


def outlines(pages: DataFrame) -> DataFrame:
    """The subtrees of every distinct page, without its text."""
    return materialize(_parsed(pages, _OUTLINE).groupBy(*_KEY).agg(*[F.any_value(c).alias(c) for c in ("subtrees", "firsts", "ends")]), "html-outlines")


def site_templates(distinct: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree): subtrees that recur on enough distinct pages of their host."""
    counts = (distinct.select("host", F.explode(F.array_distinct("subtrees")).alias("subtree")).groupBy("host", "subtree")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEWEST).withColumn("part", F.pmod("subtree", F.lit(SALTS))))
    n = F.col("pages")
    enough = F.when(n < 2 * min_pages, F.greatest(F.lit(FEWEST), F.ceil(n / 2))).otherwise(F.greatest(F.lit(min_pages), F.ceil(n * SHARE)))
    hosts = (distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
             .select("host", enough.alias("enough"), _parts()))        # a large host's subtrees spread
    return counts.join(hosts, ["host", "part"]).where(F.col("n") >= F.col("enough")).select("host", "subtree")


def _parts():
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``."""
    distinct = outlines(pages)
    template = site_templates(distinct, min_pages).select("*", _parts())
    held = distinct.select(*_KEY, F.pmod("k1", F.lit(SALTS)).cast("int").alias("part"), F.inline(F.arrays_zip("subtrees", "firsts", "ends")))
    gone = (held.withColumnRenamed("subtrees", "subtree").join(template, ["host", "subtree", "part"])
            .groupBy(*_KEY).agg(F.collect_list(F.struct("firsts", "ends")).alias("gone")))
    # written first, so that the planner knows its size before it decides whether the texts must be shuffled
    gone = materialize(gone, "html-gone").select("*", _parts())
    rows = (_parsed(pages, _SEGMENTS).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))    # copies spread
            .join(gone, [*_KEY, "part"], "left").select("page_id", "url", "texts", "blocks", "flags", "gone"))

    def run(batches):
        for b in batches:
            text = [choose(t.as_py(), k.as_py(), f.as_py(), [(g["firsts"], g["ends"]) for g in gone.as_py() or ()])
                    for t, k, f, gone in zip(*(b.column(c) for c in ("texts", "blocks", "flags", "gone")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
