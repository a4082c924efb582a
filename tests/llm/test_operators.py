"""Each operator against brute force on a small table of nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from kairolog.llm import html_extraction, ngram_join, packing, quality, sharding, substring_dedup, toxicity, url_filters
from kairolog.llm import decontamination as deco
from kairolog.llm import line_dedup as lines
from kairolog.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words string, shard string, digest string, path string"
rng = random.Random(5)
VOCABULARY = [f"{a}{b}{c}" for a in "btkm" for b in "aeo" for c in ("n", "rs", "lté", "x,")]


def words(n):
    return [rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(n)]


def corpus():
    passage, base = " ".join(words(70)), words(150)
    near = list(base)
    near[20] = "changed"
    block = "\n".join(" ".join(words(6)) for _ in range(12))
    texts = [
        " ".join(base), " ".join(near), " ".join(base), " ".join(words(40)) + "\n" + passage, passage + "\t" + " ".join(words(30)),
        "intro " + " ".join(words(9)) + "\n" + block, block + "\nafter " + " ".join(words(9)), None, "", "  \n ", "one two", "one two", " ".join(words(6000)) + " " + passage,
        "A | B | C | D | E | F | G | H | I | J | K", "spam spam " * 30, "é " * 5 + "ÀB " * 30,
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, passage, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def split(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, rows):
    least = {}
    key = lambda i: i if i is not None else (1 << 63) - 1
    for i, t, *_ in rows:
        w = split(t)
        for a in range(len(w) - 49):
            x = tuple(w[a : a + 50])
            least[x] = min(least.get(x, key(i)), key(i))
    want = []
    for i, t, *_ in rows:
        w, gone = split(t), set()
        for a in range(len(w) - 49):
            if least[tuple(w[a : a + 50])] < key(i):
                gone |= set(range(a, a + 50))
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for a, x in enumerate(w) if a not in gone)).hexdigest()))
    for options in ({}, {"shard_chars": 200, "part_bytes": 500}):
        assert sorted(map(tuple, substring_dedup.substring_dedup(docs, **options).collect()), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 100


def test_substring_phrase_over_an_edge():
    import pyarrow as pa

    texts = pa.array(["a b" + " same" * 5, "same " * 60])
    own = substring_dedup.Windows(texts, 50, 12).chosen[:1].view("int64").tolist()
    batch = pa.RecordBatch.from_arrays([texts, pa.array([[], own], pa.list_(pa.int64()))], ["text", "own"])
    (got,) = substring_dedup._fetch(50, 12)(iter([batch]))
    assert got.to_pylist() == [{"phrase": own[0], "body": b" ".join([b"same"] * 12)}]


def test_substring_places_decide(rows):
    """Windows follow from the places that the automaton finds: none without them, others with others."""
    import ahocorasick
    import numpy as np
    import pyarrow as pa

    text = [b"x", b"a", b"b", b"a", b"b", b"ab"]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    automaton.add_word(" a b ")
    automaton.make_automaton()
    assert substring_dedup.located(automaton, text).tolist() == [1, 3]
    w = substring_dedup.Windows(pa.array([rows[0][1]]), 50, 12)
    every = w.around(np.arange(len(w.grams)), 39)
    assert every.tolist() == list(range(len(w.at))) and len(w.around(np.empty(0, np.int64), 39)) == 0
    for p in range(0, len(w.grams), 7):  # only windows that hold the phrase, and chose it
        held = w.around(np.array([p]), 39)
        assert held.tolist() == [s for s in range(len(w.at)) if s <= p <= s + 38 and w.grams[s : s + 39].min() == w.grams[p]]


def test_line_dedup(docs, rows):
    def chunks(text):
        out, cur, before = [], [], 0
        for i, x in enumerate(all_lines := text.split("\n")):
            n = int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
            cur.append(x)
            if (n * lines.FACTOR + before) % lines.ONE_IN == 0 and len(cur) > 1 or i == len(all_lines) - 1:
                out.append((i - len(cur) + 1, cur))
                cur = []
            before = n
        return out

    first = {}
    unique = {(i, t) for i, t, *_ in rows if t is not None}
    for i, t in sorted(unique, key=lambda r: (r[0] is not None, r[0] or 0)):
        for a, c in chunks(t):
            if len(c) > 1 and sum(bool(split(x)) for x in c) > 1:
                first.setdefault("\n".join(c), (i, t, a))
    want = []
    for i, t, *_ in rows:
        kept = None if t is None else "\n".join(x for a, c in chunks(t) if first.get("\n".join(c), (i, t, a)) == (i, t, a) for x in c)
        want.append((i, kept))
    got = [(r.doc_id, r.text) for r in lines.line_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(a != r[1] for (_, a), r in zip(want, rows, strict=True))
    assert lines.line_dedup(docs).columns == docs.columns


def test_repeated_runs(spark, docs, rows):
    def pairs(text):
        all_lines = text.split("\n")
        inked = [i for i, x in enumerate(all_lines) if split(x)]
        return [(a, b, "\n".join(all_lines[a : b + 1])) for a, b in zip(inked, inked[1:], strict=False)]

    block = [f"line {i} of the block" for i in range(9)]
    more = [(i, "\n".join(x), "en", "s", 0) for i, x in enumerate([["a b", *block, "c d"], block, ["e f", *block[2:6], "", "g h"], [*block[:2], "", " ", block[2]], ["", block[0], "", "i j"], ["k"] * 5, ["k", "", "k"]], 100)]
    first, every = {}, [*rows, *more]
    for i, t in sorted({(i, t) for i, t, *_ in every if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for a, _, x in pairs(t):
            first.setdefault(x, (i, t, a))
    want = []
    for i, t, *_ in every:
        gone = set() if t is None else {x for a, b, p in pairs(t) if first[p] != (i, t, a) for x in range(a, b + 1)}
        want.append((i, None if t is None else "\n".join(x for a, x in enumerate(t.split("\n")) if a not in gone)))
    table = docs.union(spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in more], SCHEMA))
    got = corpus_pipeline.dedup_lines(spark, table, "")
    assert got.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = dict(want)
    assert kept[101] == "" and kept[102] == "e f\n\ng h" and kept[105] == "k" and kept[6].startswith("after ")
    left = {r.doc_id for r in corpus_pipeline.join_ngrams(spark, got, "").collect()}
    assert 100 in left and not {7, 8, 9, 101} & left
    assert all(r.n_chars == len(r.text) for r in got.where("doc_id in (6, 101, 102)").collect())


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer, held = Tokenizer.from_file(vocabulary()), defaultdict(list)
    out = packing.pack(docs, vocabulary(), sequence=64, with_ids=True).collect()
    space = sorted((r.sequence_id, r.offset, r.length) for r in out)
    at = 0
    for s, o, n in space:
        assert s * 64 + o == at and o + n <= 64
        at += n
    for r in out:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        held[r.doc_id].append(r)
    total = Counter()
    for i, t, *_ in rows:
        total[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert {i: sum(r.length for r in p) for i, p in held.items()} == dict(total)
    ids = lambda t: b"".join(int(x).to_bytes(4, "little") for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    want, place = Counter((i, ids(t)) for i, t, *_ in rows), {}
    for r in out:
        place[r.sequence_id * 64 + r.offset] = r
    got, text = Counter(), b""
    for _, r in sorted(place.items()):  # the pieces of a document follow one another
        assert r.start * 4 == len(text)
        text += bytes(r.ids)
        if len(text) == 4 * r.doc_tokens:
            got[r.doc_id, text] += 1
            text = b""
    assert got == want and not text


def test_sharding(docs, rows):
    placed, _ = sharding.shard_documents(docs, shards=3, virtual_slots=16)
    out = placed.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=key) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=key)
    # by brute force: slots of a shard in order, the rows of each by id, checksum and size
    held = defaultdict(list)
    for r in out:
        held[r.virtual_slot].append(r)
    at = Counter()
    for v in sorted(held):
        assert len({r.shard for r in held[v]}) == 1
        for r in sorted(held[v], key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"])):
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 3
            held[v].sort(key=lambda r: r.slot)
        assert [r.slot for r in held[v]] == list(range(at[held[v][0].shard], at[held[v][0].shard] + len(held[v])))
        at[held[v][0].shard] += len(held[v])
    sizes = {v: rng.randrange(100) + 1 for v in range(400)}
    load = Counter()
    for v, s in enumerate(sharding.rebalanced(sharding.first_map(400, 7), sizes, 7)):
        load[s] += sizes[v]
    assert max(load.values()) - min(load.values()) <= 100


def test_sharding_edits_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    table = lambda n, big: spark.createDataFrame([(i, "x" * (3000 if i in big else 40)) for i in range(n)], "doc_id long, text string")
    out, where = sharding.shard_documents(table(600, ()), shards=4, virtual_slots=64, map_path=path)
    first, before = sharding.load_map(spark, path)
    assert where == path and sharding.load_map(spark, path, 1)[1] == sharding.first_map(64, 4) and {r.map_version for r in out.collect()} == {first}
    out, _ = sharding.shard_documents(table(600, (5, 6, 7)), shards=4, virtual_slots=64, map_path=path)
    version, after = sharding.load_map(spark, path)
    rows = out.collect()
    bytes_of, load = Counter(), Counter()
    for r in rows:
        bytes_of[r.virtual_slot] += r["size"]
        load[before[r.virtual_slot]] += r["size"]
    moved = [v for v in range(64) if before[v] != after[v]]
    mean = sum(bytes_of.values()) / 4
    assert version == first + 1 and moved and all(load[before[v]] > mean for v in moved) and len(moved) < 32
    assert all(r.shard == after[r.virtual_slot] and r.map_version == version for r in rows)
    again, _ = sharding.shard_documents(table(600, (5, 6, 7)), shards=4, virtual_slots=64, map_path=path)
    kept = sharding.load_map(spark, path)
    assert again.count() == 600 and (kept[0] == version or kept[1] != after)
    with pytest.raises(ValueError):
        sharding.shard_documents(table(3, ()), shards=4, virtual_slots=8, map_path=path)


def test_sharding_of_one_record_repeated(spark):
    rows = spark.createDataFrame([(1, "same text of it")] * 900 + [(i, f"other {i}") for i in range(300)], "doc_id long, text string").repartition(3)
    out = sharding.shard_documents(rows, shards=4, virtual_slots=64)[0].collect()
    load = Counter()
    for r in out:
        load[r.shard] += r["size"]
    assert len(out) == 1200 and max(load.values()) < 1.1 * min(load.values())
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_decontamination(spark, docs, rows):
    items = [("i1", " ".join(split(rows[0][1])[i].decode() for i in range(30, 52))), ("i10", "one TWO"), ("i2", ""), ("i3", None), ("i4", rows[3][1]), ("i5", "two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    want = []
    for i, t, *_ in rows:
        w, hit, found = low(t), set(), set()
        for item, text in items:
            v = low(text)
            for x in {tuple(v[a : a + 10]) for a in range(max(len(v) - 9, 1))} - {()}:
                for a in range(len(w) - len(x) + 1):
                    if tuple(w[a : a + len(x)]) == x:
                        hit |= set(range(a, a + len(x)))
                        found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for bound in (deco.SET_BOUND, 0):
        got = deco.contamination(docs, bench, set_bound=bound).drop("row").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert deco.decontaminated(docs, bench).count() == sum(not w[-1] for w in want)
    assert deco.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_quality(docs, rows):
    out = sorted((tuple(r) for r in quality.quality_metrics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = [x.decode() for x in split(t)]
        g = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
        rep = {b for a in range(len(w) - 4) if g[tuple(w[a : a + 5])] > 1 for b in range(a, a + 5)}
        inked = [x for x in t.split("\n") if split(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(quality.SYMBOLS, t)), len(inked) - len(set(inked)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    assert out == sorted(want, key=str)
    kept = {r.doc_id for r in quality.clean(docs).collect()}
    assert {0, 1, 3, 12} <= kept and not {7, 8, 13, 14} & kept
    assert quality.clean(docs).columns == docs.columns


LEAN = html_extraction.weights(html_extraction.examples())


def learned_from(*pages):
    return html_extraction.weights(sum(map(html_extraction.counts, pages), html_extraction.examples()))


def test_html():
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><nav><li>Menu</li></nav><!-- <p>x --><article><h1>Head &amp; tail</h1><p>Some <b>bold</b>face words <br>here 1 < 2.<div class='ad'>Buy now</div><form>Name</form><p>More &lt;words&gt; there</p></article><div id=comments><p>I like it</p></div><footer><p>Foot text</p></footer>"
    for weight in (LEAN, learned_from(page)):
        assert html_extraction.extract(page, weight) == "Head & tail Some boldface words here 1 < 2. More <words> there"
    assert html_extraction.extract("", LEAN) == "" and html_extraction.extract("<script>x", LEAN) == "" and html_extraction.extract("plain", html_extraction.Lean({})) == "plain"


def test_html_region_by_brute_force():
    for n in (0, 1, 2, 5, 30):
        for _ in range(60):
            x = [rng.choice((-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)) for _ in range(n)]
            lo, hi = html_extraction.best_region(x)
            assert sum(x[lo:hi]) == max([0.0, *(sum(x[a:b]) for a in range(n) for b in range(a + 1, n + 1))]) and (lo < hi or lo == hi == 0)


def test_html_weights_decide():
    """What goes and what stays follows from the weights alone: a class that no list knows, learned from labelled pages."""
    page = "<body><div class='zork'>Go on buying things here</div><div class='story'><p>one two three four</p><div class='zork'>and here</div><p>five six</p></div><div class='zork'>or here</div></body>"
    assert html_extraction.extract(page, LEAN) == "Go on buying things here one two three four and here five six or here"
    labelled = "<body><article><p>word of the text</p></article><div class='zork'>" + "beside it " * 60 + "</div></body>"
    assert html_extraction.extract(page, learned_from(labelled)) == "one two three four five six"
    turned = html_extraction.Lean({k: 0.01 if x > 1 else 3.0 for k, x in LEAN.trait.items()})
    assert html_extraction.extract("<body><nav>to the menu</nav><p>one two</p></body>", turned) == "to the menu"
    # without any element around it, only the scan can leave out the row of empty cells and the word beyond
    assert html_extraction.extract("<p>one two three</p>" + "<hr>" * 250 + "word", LEAN) == "one two three"


def test_html_lists_in_an_article():
    menu = "<nav><ul>" + "<li><a href='/x'>Menu word</a></li>" * 8 + "</ul></nav>"
    learned = learned_from(f"<body>{menu}<article><h1>Head</h1><p>{'word ' * 50}</p></article><footer>Foot</footer></body>")
    assert learned.trait["<li>"] > 1 and learned.trait["<nav>"] == html_extraction.LEAST and min(learned.trait.values()) > 0
    items = "<ul>" + "".join(f"<li>item number {i} of it</li>" for i in range(60)) + "</ul>"
    said = " ".join(f"item number {i} of it" for i in range(60))
    assert html_extraction.extract(f"<body>{menu}<article><p>one two</p>{items}<p>three four</p></article><footer>Foot</footer></body>", learned) == f"one two {said} three four"
    assert html_extraction.extract(f"<body>{menu}<article><p>one two</p>{items}</article><footer>Foot</footer></body>", learned) == f"one two {said}"
    assert html_extraction.extract("<article><p>one two<nav>x</nav>three four</p></article>", LEAN) == "one two three four"


def test_html_content_of_an_article():
    for part, said in (
        ("<figure><pre>some code here</pre><figcaption>a caption of it</figcaption></figure>", "some code here a caption of it"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so x=1 holds"), ("<object><p>instead of it</p></object>", "instead of it"), ("<dialog open><p>say it now</p></dialog>", "say it now"),
        ("<svg><title/><text>drawn words</text></svg>", "drawn words"), ("<svg/><p>after it all</p>", "after it all"), ("<p>so <math/> on <object/>it goes</p>", "so on it goes"),
        ("<section id='related-work'><p>work of others</p></section>", "work of others"), ("<h2 id=search>how we search</h2>", "how we search"), ("<div class='share-prices'>share prices fell</div>", "share prices fell"),
        ("<div class='wide ad'>buy it now</div>", ""), ("<ul class=breadcrumbs><li>one up here</li></ul>", ""), ("<section class=comments><article class=comment><p>so I say</p></article></section>", ""), ("<div id=comments>so they say</div>", ""),
    ):
        assert html_extraction.extract(f"<article><p>one two three four</p>{part}<p>five six seven eight</p></article>", LEAN) == f"one two three four {said} five six seven eight".replace("  ", " "), part
    assert html_extraction.extract("<p>one two three</p><dialog>log in</dialog><div id='share-box'>tell them all</div>", LEAN) == "one two three"
    assert html_extraction.extract("<div class='page has-sidebar'><article><p>one two three</p></article><div class='ad-slot-3'>buy now</div></div>", LEAN) == "one two three"


def test_html_stray_quotes():
    for tag in ("<p title=it's>", '<p title="5" tall">', "<p it's>", '<p title= "a > b">', "<p title='a > \"b'>", '<p title=">'):
        for end in ("", "<p>it's \"so\" now</p>")[: 1 if tag.endswith('=">') else 2]:
            page = f"<article><p>one two three</p>{tag}four five six</p>{end}</article>"
            assert html_extraction.extract(page, LEAN) == "one two three four five six" + (" it's \"so\" now" if end else ""), page
    assert html_extraction.extract("<p " + "a='b\"=" * 20000, LEAN) == ""


def test_html_long_and_deep():
    assert html_extraction.extract("<article>" + "<p>some words &amp; more</p>" * 50_000 + "</article>", LEAN) == " ".join(["some words & more"] * 50_000)
    assert html_extraction.extract("<div>" * 3000 + "word " * 100 + "</div>" * 3000, LEAN) == " ".join(["word"] * 100)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b</p></article><footer>no</footer>", "x"), (1, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in html_extraction.extract_pages(pages).collect()), key=str) == [(1, "", 0), (1, "a b", 3), (None, "", 0)]
    assert html_extraction.extract_pages(pages.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        "https://Example.com/en/71?x": ("allow", "example.com/en/7"), "http://a.com/en/1": ("block", "com/en/"), "http://x.example.net/de/8": ("block", "example.net/de/8"), "http://x.net/de/9": ("allow", "net/de/"),
        "http://netx/de/9": ("allow", None), "http://spam-farm.example.org/en": ("block", None), "no scheme": ("allow", None), None: ("allow", None), "http://x.org": ("allow", None), "http://x.io/login?a": ("block", None),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*cases, *cases])], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_filters.url_filters(pages).collect()}
    assert got == dict(enumerate([*cases.values(), *cases.values()]))
    assert url_filters.url_filters(pages.limit(0)).count() == 0


def test_url_rules_of_a_table(spark):
    for pattern, tokens in (("/login[0-9]*/", ()), ("[.]shop[.]", ("shop",)), ("/a/b1-c$", ("a", "b1", "c")), ("(x|y)ab/", ()), ("/foo(bar)?/", ()), ("://([^/]*[.])?ads[.]", ("ads",)), ("abc", ())):
        assert url_filters.literal_tokens(pattern) == tokens, pattern
    rules = [(f"rule {i}", p) for i, p in enumerate(["/login[0-9]*/", "[.]shop[.]", "/w7/(x|y)ab/", "://([^/]*[.])?w3[.]", "[?&]w5=[0-9]", "/w1/w2([/]|$)"])]
    word = lambda: rng.choice(["login", "login7", "shop", "xab", "yab", "w1", "w2", "w3", "w5", "w7"])
    urls = [f"http://{word()}.{word()}.org/{word()}/{word()}/{word()}?{word()}=3&{word()}=x" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate([*urls, None])), "page_id long, url string")
    got = {r.page_id: r.pattern_rule for r in url_filters.url_filters(pages, (), spark.createDataFrame(rules * 2, "name string, pattern string")).collect()}
    want = {i: min((n for n, p in rules if u and re.search(p, u)), default=None) for i, u in enumerate([*urls, None])}
    assert got == want and len(set(want.values())) == 7


def test_toxicity_interactions(spark, docs):
    rows, labels = [], []
    for i in range(900):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = words(20) + ["wretch"] * insult + ["folk"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group), 1))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    out = toxicity.toxicity(d, lab).collect()
    truth = {i: y for i, y, _ in labels}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out) and len(held) > 200
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    hidden = lab.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r.doc_id: r.score for r in toxicity.toxicity(d, hidden).collect()} == {r.doc_id: r.score for r in out}
    assert toxicity.toxicity(docs, lab.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0
    # every score is the sum over features and over pairs of features, one by one
    import math

    import numpy as np
    import pyarrow as pa

    model = toxicity.train(d, lab)
    texts = [t for _, t in rows[:40]] + ["", None, "wretch folk wretch"]
    found, feature = toxicity.features(pa.array(texts))
    for i, score in enumerate(toxicity.scores(model, pa.array(texts))):
        at = sorted({int(model.slot[x]) for x in feature[found == i]} - {-1})
        z = model.bias + sum(model.linear[a] for a in at) + sum(float(np.dot(model.factors[a], model.factors[b])) for n, a in enumerate(at) for b in at[n + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    # rows that repeat a labelled id don't outgrow the sample
    bounded = toxicity.train(d.union(d).union(d), lab, sample=50)
    assert (bounded.linear == toxicity.train(d, lab, sample=50).linear).all()


def test_ngram_join(docs, rows):
    sets = []
    for i, t, *_ in rows:
        w = split(t)
        sets.append((i, frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    links = [[j for j, (_, y) in enumerate(sets) if j != i and x and y and len(x & y) >= 0.8 * len(x | y)] for i, (_, x) in enumerate(sets)]
    for options in ({}, {"small": 2, "block": 2}):
        got = ngram_join.jaccard_join(docs, **options).collect()
        assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, len(n)) for (i, _), n in zip(sets, links, strict=True))
        by = {r.doc_id: r.class_id for r in got}
        assert by[1] == by[2] == by[0] == 0 and by[11] == 10 and by[5] == 5
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} >= {0, 3, 10} and 1 not in {r.doc_id for r in ngram_join.one_of_each(docs).collect()}


def test_ngram_all_pairs(spark):
    """Every link among the documents of the test tables, against all pairs."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = split(r.text)
        sets[r.doc_id] = frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    links = {i: {j for j, y in sets.items() if j != i and x and y and len(x & y) >= 0.8 * len(x | y)} for i, x in sets.items()}
    group = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in group:
                group[j] = i
                todo += links[j]
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.jaccard_join(docs).collect()}
    assert got == {i: (len(n), group[i]) for i, n in links.items()} and sum(map(len, links.values())) > 0


def test_ngram_screen_loses_nothing():
    import numpy as np
    import pyarrow as pa

    gen = np.random.default_rng(3)
    base = [gen.integers(0, 2**63, n).astype(np.uint64) for n in (3, 40, 63, 64, 70, 300, 900)]
    sets = []
    for b in base:
        for drop in (0, 1, len(b) // 20, len(b) // 6, len(b) // 3):
            sets.append(np.unique(np.concatenate([b[drop:], gen.integers(0, 2**63, drop // 2).astype(np.uint64)])))
    flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    drawn, size = ngram_join.sketches(flat, ends).to_pylist(), np.array(list(map(len, sets)))
    side = gen.integers(0, 2, len(sets))
    for sides in (None, side):
        may = ngram_join.partners(drawn, size, sides, 0.8)
        near = [any(i != j and (sides is None or sides[i] != sides[j]) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
        assert all(may[near]) and sum(near) > 8 and not may.all()
    assert isinstance(ngram_join.sketches(flat, ends), pa.BinaryArray)


def test_one_of_each_without_ids(spark):
    base = words(60)
    near = [*base[:-1], "other"]
    rows = [(None, " ".join(base)), (None, " ".join(near)), (None, " ".join(base)), (None, " ".join(words(60))), (4, "five words of their own"), (4, "five words of their own"), (4, "five words of their"), (None, None), (7, None), (7, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, nul int, Times int")
    out = ngram_join.one_of_each(docs)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and Counter(kept) == Counter([rows[0] if rows[0] in kept else rows[1], rows[3], rows[4], rows[6], (None, None), (7, None), (7, None)])
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_join(docs).collect())
    assert got == Counter({(None, None, 2): 3, (None, None, 0): 2, (4, 4, 1): 2, (4, 4, 0): 1, (7, 7, 0): 2})


CLASHING = "doc_id long, text string, n_chars long, `__row` string, `__text` string, `__id` string, `__lines` string, `__first` string, whole string, aside string, nul string, `doc` string"


def test_clashing_names(spark, rows):
    docs = spark.createDataFrame([(i, t, n, *(f"{c}{i}" for c in "abcdefghi")) for i, t, _, _, n in rows], CLASHING)
    bench = spark.createDataFrame([("i", rows[3][1])], "item_id string, text string")
    for stage in (quality.clean, lines.line_dedup, lines.run_dedup, ngram_join.one_of_each, lambda d: deco.decontaminated(d, bench)):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all([r[k] == f"{c}{r.doc_id}" for k, c in zip(range(3, 12), "abcdefghi", strict=True)] for r in out.collect())
    assert deco.contamination(docs.limit(0), bench).count() == 0 and quality.clean(docs).count() > 4


def test_ngram_large_group(spark):
    base = words(120)
    rows = []
    for i in range(80):
        w = list(base)
        w[i % 120] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=8, block=16).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 79)}


@pytest.mark.parametrize("run", [lambda d: substring_dedup.substring_dedup(d), lambda d: lines.line_dedup(d), lambda d: packing.pack(d, vocabulary()), lambda d: sharding.shard_documents(d)[0], quality.quality_metrics, lambda d: ngram_join.jaccard_join(d)])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [ngram_join.MOST, 1 << 16])
def test_ngram_sift_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MOST", most)
    rows = spark.range(100_000).selectExpr("id % 10 = 0 AS nul", "id AS doc", "xxhash64(id) AS row", "concat('text ', id) AS text")
    keys = ["nul", "doc", "row"]
    wanted = rows.where("doc % 20 = 0").select(keys)
    got = ngram_join.sifted(rows, wanted)
    assert got.columns == rows.columns
    got = {r.doc for r in got.collect()}
    assert got >= set(range(0, 100_000, 20))
    assert len(got) < 5000 + (95_000 * 0.1 if most > 1 << 16 else 95_000 * 0.2)
    assert ngram_join.sifted(rows, wanted.limit(0)).count() == 0 == ngram_join.sifted(rows.limit(0), wanted).count()


def test_ngram_fetches_only_texts_with_partners(spark, monkeypatch):
    """Of a large bucket, all travel to be split, and only those with a possible partner to be compared."""
    asked, sift = [], ngram_join.sifted
    monkeypatch.setattr(ngram_join, "sifted", lambda rows, wanted: asked.append(wanted.count()) or sift(rows, wanted))
    near = words(100)
    rows = [(i, " ".join([*near[:99], f"end{i}"])) for i in range(2)] + [(i, " ".join(["these", "five", "words", "are", "shared", *(f"w{i}x{j}" for j in range(8))])) for i in range(2, 60)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=8, block=16).collect()}
    assert got == {0: (0, 1), 1: (0, 1)} | {i: (i, 0) for i in range(2, 60)}
    assert asked[0] >= 50 and asked[-1] == 2
