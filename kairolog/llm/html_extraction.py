"""HTML extraction by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score above zero, tags below, by weights counted on labelled pages
(``learned``): the few of ``EXAMPLES``, and of the pages that mark their main text as ``<article>`` a bounded sample
(``SAMPLE`` pages at most, smallest hashes first). What decides about an element is its traits: its class, id and role
tokens, or its name if it has none. A trait's lean is how many more words of the labelled main texts stand under it
than words of what stands beside them; a word scores by the least lean of the elements around it, and the tags of an
element that leans out cost more than others. Outside articles an unknown trait such as ``ad-slot-3`` leans like the
least of its parts, unless an article or main element stands within; in articles only whole traits of boxes count.

One linear scan, from the inside of elements to their outside, finds the best region: an element whose best sum stays
below zero is left out of the region at a bounded cost, and of the sequence that remains the contiguous part with the
largest sum is the main text. So a menu at the edge costs the scan more than it brings and isn't reached, one in the
middle is crossed, and both are decided by the same scores. The region is written block by block.

Cases: a null, empty or wordless page has an empty text; unclosed comments and scripts run to the end of the page; a
``<`` that opens no tag is text; pages of one url or id are treated one by one; extra columns are ignored; with no
weights at all every word scores 1 and every tag a little below zero; an empty table gives an empty result; pages may
be of any length and depth.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import ship

SAMPLE, EXAMPLE = 2000, 200  # pages; for how many pages an example stands
MOST, LEAST, OUT, TAG_COST, OUT_COST, CROSSING = 3.0, 0.01, 0.1, -0.01, -4.0, -0.5
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub object".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = re.compile(r"(?i)(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
CLASS = re.compile(r"(?i)(?<![^\s\"'])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
CONTAINERS = frozenset("div ul ol dl table section".split())  # within an article, only classes of these, and ids of div, are traits
FRAMES = frozenset("html body main article div section span".split())  # their names say nothing
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")  # a quote opens a string right after = only

#: Labelled pages: the main text is the ``article``; elements within it that hold ``data-out`` don't belong to it.
EXAMPLES = (
    """<body><div class="header masthead banner"><p>Site of the day</p></div><nav class="nav navbar navigation"><ul><li>Home page</li></ul></nav><ul class="menu breadcrumb breadcrumbs"><li>You are here</li></ul>
    <div class="cookie cookies consent notice notices alert" role="alert"><p>We use these</p></div><article><header><h1>A title of some words</h1></header><p>Text of the first part, with several words in it.</p>
    <ul><li>first item of a list in the text</li><li>second item of it</li></ul><ol><li>one of the steps to take</li></ol><dl><dt>term</dt><dd>what the term means here</dd></dl>
    <table><tr><th>year</th><td>value of that year</td></tr></table><figure><pre>some lines of code</pre><figcaption>caption of the figure</figcaption></figure><blockquote>words that somebody said</blockquote>
    <aside data-out>Other things you may read</aside><form data-out>Your name here</form><nav data-out>Contents list</nav><div class="ad ads advert advertisement advertising sponsor sponsored promo promotion" data-out>Buy this now</div><svg><text>drawn words</text></svg><dialog>say it</dialog>
    <section><h2>Second part of the text</h2><p>More text in the second part of it.</p></section><footer data-out>Filed under these tags</footer></article>
    <aside class="sidebar side-bar"><p>Popular things</p></aside><section id="comments"><div><p>I like this very much</p></div></section><div class="comment comments replies respond disqus"><p>So do I</p></div>
    <footer class="footer"><p>All rights are ours</p></footer></body>""",
    """<body><header>Name of the site</header><form class="search login">Find</form><menu>One two</menu><select><option>Pick one</option></select><button>Press</button><div role="navigation">Go there</div><div role="banner">On top</div>
    <div role="contentinfo">At the end</div><div role="complementary">Beside it</div><div role="search">Look for</div><div role="dialog">Look here</div><dialog>Welcome back</dialog><article><h1>Another title</h1><h2>with a second line</h2><h3>and a third</h3><p>Words and words and more words of it.</p>
    <div>plain box of text</div><ul class="share social related" data-out><li>tell them</li></ul></article><div class="popup modal newsletter subscribe">Get our letter</div><div class="share social">Tell all</div><div class="related">Read on</div></body>""",
)


class Token(NamedTuple):
    """A run of text, or a tag; ``depth``: 1 opens an element, below 0 closes so many; ``traits``: of an opening tag."""

    text: str | None
    depth: int
    traits: tuple[str, ...]
    article: bool = False
    frame: bool = False  # an article or main element
    out: bool = False


def traits(name: str, attributes: str, inside: bool) -> tuple[str, ...]:
    """What may tell whether an element belongs to the main text."""
    held: list[str] = []
    if attributes and name not in ("html", "body", "article", "main") and (not inside or name in CONTAINERS):
        found = (CLASS if inside and name != "div" else NAMED).findall(attributes)
        held = [x.lower() for a, b, c in found for x in (a or b or c).split()]
    if name not in FRAMES and (not held or name in ("nav", "aside", "footer", "form", "button", "select", "menu")):
        held.append(f"<{name}+>" if inside and name in ("header", "dialog") else f"<{name}>")
    return tuple(held)


def tokens(page: str) -> Iterator[Token]:
    """Runs of text and block tags. An element that the page leaves open is closed by the end of one around it."""
    open_: list[str] = []
    at, articles = 0, 0
    while at < len(page):
        lt = page.find("<", at)
        if lt != at:
            yield Token(page[at : lt if lt >= 0 else len(page)], 0, ())
            if lt < 0:
                return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = TAG.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a tag with a stray quote, or cut off
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else len(page)
            else:
                yield Token("<", 0, ())
                at = lt + 1
            continue
        at, closing, name = m.end(), bool(m[1]), m[2].lower()
        if name in RAW and not closing and not (m[3].endswith("/") and "svg" in open_):  # only foreign elements close themselves
            end = re.compile(f"(?i)</{re.escape(name)}[^>]*>").search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in INLINE:
            continue
        if closing:
            if name in open_:
                n = open_[::-1].index(name) + 1
                articles -= open_[-n:].count("article")
                del open_[-n:]
                yield Token(None, -n, ())
            else:
                yield Token(None, 0, ())
        else:
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and open_ and open_[-1] in (("p",) if name == "p" else ("p", name) if name not in ("dt", "dd") else ("p", "dt", "dd")):
                open_.pop()  # these end where the next begins
                yield Token(None, -1, ())
            if name in VOID or m[3].endswith("/"):
                yield Token(None, 0, ())
            else:
                yield Token(None, 1, traits(name, m[3], articles > 0), name == "article", name in ("article", "main"), "data-out" in m[3])
                open_.append(name)
                articles += name == "article"


class Lean(NamedTuple):
    """Weights of traits."""

    trait: dict[str, float]

    def of(self, held: tuple[str, ...], inside: bool) -> tuple[float, float]:
        """Of an element: the least over its traits that are known, and over parts of the others; 1 if there are none."""
        known = [self.trait[x] for x in held if x in self.trait]
        parts = [] if inside else [self.trait.get(p, 1.0) for x in held if x not in self.trait and x[0] != "<" for p in re.split(r"[-_\d]+", x)]
        return min(known, default=1.0), min(parts, default=1.0)


def counts(page: str) -> Counter[tuple[str, bool]]:
    """Of a labelled page: words of the main text by the traits of all elements in it around them, and words beside it
    by those of the outermost element that holds none of it; in an article, that is one with ``data-out`` or one that the
    standard sets apart."""
    seen = list(tokens(page))
    holds, stack = set(), []
    for i, t in enumerate(seen):  # elements around an article
        if t.article:
            holds |= set(stack)
        if t.depth > 0:
            stack.append(i)
        elif t.depth:
            del stack[t.depth :]
    found: Counter[tuple[str, bool]] = Counter()
    stack, article, out = [], 0, None  # out: how deep the outermost element beside the main text is
    root = 0  # how deep the article is
    for i, t in enumerate(seen):
        if t.depth > 0:
            stack.append(t)
            article += t.article
            root = len(stack) if article == 1 and t.article else root
            apart = t.out or bool({"<nav>", "<aside>", "<footer>", "<form>"} & set(t.traits)) if article else i not in holds
            if out is None and apart:
                out = len(stack)
        elif t.depth:
            article -= sum(x.article for x in stack[t.depth :])
            del stack[t.depth :]
            out = None if out is not None and len(stack) < out else out
        elif t.text:
            n = len(t.text.split())
            if out is not None:
                for x in stack[out - 1].traits:
                    found[x, False] += n
            elif article:
                for x in {y for e in stack[root:] for y in e.traits}:
                    found[x, True] += n
    return found


def weights(found: Counter[tuple[str, bool]]) -> Lean:
    """Log odds, smoothed, brought to one above zero for words: from ``LEAST`` for what always stands beside, 1 for what tells nothing."""
    lean = {x: math.log((found[x, True] + 1) / (found[x, False] + 1)) for x in {k for k, _ in found}}
    return Lean({x: max(LEAST, math.exp(v)) if v < 0 else min(MOST, 1 + v) for x, v in lean.items()})


def extract(page: str, lean: Lean) -> str:
    """The text of the region with the largest sum."""
    seen = list(tokens(page))
    score, cut = [0.0] * len(seen), [0] * len(seen)  # cut: from here, up to there, the region leaves out
    open_: list[tuple[int, float, float, float, float, bool]] = []  # where, and what held before
    known, part, high, total, inside = 1.0, 1.0, 1.0, 0.0, False

    def close(end: int) -> None:
        nonlocal known, part, high, total, inside
        begin, known, part, high, before, inside = open_.pop()
        if total < 0:  # nothing in it outweighs its tags: crossed at a bounded cost
            cut[begin] = end
            score[begin] = total = max(total, CROSSING)
        total += before

    for i, t in enumerate(seen):
        if t.depth > 0:
            open_.append((i, known, part, high, total, inside))
            whole, pieces = lean.of(t.traits, inside)
            known, part, total = min(known, whole), 1.0 if t.frame else min(part, pieces), 0.0
            high, inside = whole if whole > 1 else high, inside or t.article
            score[i] = OUT_COST if min(known, part) < OUT else TAG_COST
        elif t.text is not None:
            least = min(known, part)
            score[i] = (least if least < 1 else high) * len(t.text.split())
        else:
            score[i] = TAG_COST
        total += score[i]
        for _ in range(-t.depth if t.depth < 0 else 0):
            close(i + 1)
    while open_:
        close(len(seen))
    steps = list(_steps(score, cut))
    lo, hi = best_region([x for _, x in steps])
    shown = [t.text if t.text is not None else " " for t in (seen[i] for i, _ in steps[lo:hi])]
    return " ".join(entities.unescape("".join(shown)).split())


def _steps(score: list[float], cut: list[int]) -> Iterator[tuple[int, float]]:
    """(token, score) of the sequence without what is left out; the first token of that stands for it."""
    i = 0
    while i < len(score):
        yield i, score[i]
        i = max(i + 1, cut[i])


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the largest sum, by one linear scan; empty if none is above zero."""
    best, lo, hi, total, begin = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, lo, hi = total, begin, i + 1
    return lo, hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[tuple[str, bool]] = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            found.update(counts(page))
    if found:
        yield pa.RecordBatch.from_pydict({"trait": [k for k, _ in found], "inside": [i for _, i in found], "n": pa.array(found.values(), pa.int64())})


def _extract(lean: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", Lean(lean)) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def examples() -> Counter[tuple[str, bool]]:
    found = sum((counts(page) for page in EXAMPLES), Counter())
    return Counter({k: EXAMPLE * n for k, n in found.items()})


def learned(pages: DataFrame, sample: int = SAMPLE) -> Lean:
    """Weights from the examples and the sample. What comes to the driver has a row per trait that two sampled pages hold, so its bound is the sample's."""
    order = F.xxhash64("page_id", "url")
    marked = pages.where(F.lower("html").contains("<article"))
    last = marked.select(order.alias("o")).orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    found = examples()
    if last is not None:
        rows = marked.where(order <= last).select("html").mapInArrow(_count, "trait string, inside boolean, n long")
        found.update({(r["trait"], r["inside"]): r["n"] for r in rows.groupBy("trait", "inside").agg(F.sum("n").alias("n")).collect()})
    return weights(found)


def extract_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(_extract(learned(pages, sample).trait), f"page_id {kind}, url string, text string, n_chars long")
