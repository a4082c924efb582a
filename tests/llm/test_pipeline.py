import re
import zlib
from collections import Counter

import pytest
import regex

import corpus_pipeline
from kairolog.llm import queries
from kairolog.llm.quality import BOILERPLATE, SYMBOLS
from tests.llm.test_operators import corpus, split, words


def failing(line):
    n = len(split(line))
    bars, marks = line.count(" | "), len(re.findall(r"[!?][!?]+(?:[\x20\x09-\x0D]|$)", line))
    capitals, letters = len(regex.findall(r"\p{Lu}", line)), len(regex.findall(r"\p{L}", line))
    return (
        10 * len(re.findall(SYMBOLS, line)) > len(line) or bars >= 3 and 4 * bars >= n or letters >= 20 and 10 * capitals > 6 * letters
        or marks >= 4 and n >= 10 and 3 * marks > n or bool(re.search(BOILERPLATE, line)) and n < 25
    )


def clean(docs):
    out = []
    for i, t in docs:
        w = split(t)
        grams = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
        repeated = {b for a in range(len(w) - 4) if grams[tuple(w[a : a + 5])] > 1 for b in range(a, a + 5)}
        bad = {x for x in (t or "").split("\n") if split(x) and failing(x)}
        ink = lambda x: len(b"".join(split(x)).decode())
        if len(w) < 10 or 100 * len(repeated) > 20 * len(w) or 100 * sum(ink(x) for x in t.split("\n") if x in bad) > 30 * ink(t):
            continue
        out.append((i, "\n".join(x for x in t.split("\n") if x not in bad)))
    return out


def dedup(docs):
    def pairs(text):
        every = text.split("\n")
        inked = [a for a, x in enumerate(every) if split(x)]
        return [(a, b, "\n".join(every[a : b + 1])) for a, b in zip(inked, inked[1:], strict=False)]

    first, out = {}, []
    for i, t in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        for a, _, x in pairs(t):
            first.setdefault(x, (i, t, a))
    for i, t in docs:
        gone = {x for a, b, p in pairs(t) if first[p] != (i, t, a) for x in range(a, b + 1)}
        out.append((i, "\n".join(x for a, x in enumerate(t.split("\n")) if a not in gone)))
    return out


def one_of_each(docs):
    docs = sorted({r for r in docs if split(r[1])}, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, t in docs:
        w = split(t)
        sets.append(frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))))
    kept, seen = [], set()
    for n, r in enumerate(docs):
        if n not in seen:
            kept.append(r)
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in range(len(docs)) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    return kept


def decontaminate(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {tuple(v[a : a + 10]) for v in map(low, items) for a in range(max(len(v) - 9, 1))} - {()}
    held = lambda w: any(tuple(w[a : a + len(x)]) == x for x in windows for a in range(len(w) - len(x) + 1))
    return [(i, t) for i, t in docs if not held(low(t))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(words(40))
    rows = [(i, t) for i, t, *_ in corpus()]
    block = [" ".join(words(8)) for _ in range(5)]
    for i in range(100, 130):
        lines = [" ".join(words(12)) for _ in range(6)]
        if i % 3 == 0:
            lines[2:2] = block[: 2 + i % 4]
        if i % 5 == 0:
            lines.insert(1, passage)
        if i % 4 == 0:
            lines += ["Click here to read more", "A | B | C | D | E"]
        if i % 7 == 0:
            lines = rows[-1][1].split("\n") + [f"and one more {i}"]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [" ".join(passage.split()[5:25]), "", None, "no such item anywhere here"]
    spark.createDataFrame([(f"i{n}", t) for n, t in enumerate(items)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_rows_by_brute_force(spark, folder):
    from tokenizers import Tokenizer

    path, rows, items = folder
    docs, table = rows, queries.load(spark, path, "documents")
    brute = {"quality rules": clean, "line dedup": dedup, "n-gram Jaccard join": one_of_each, "benchmark decontamination": lambda d: decontaminate(d, items)}
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, out = brute[name](docs), stage(spark, table, path)
        assert out.columns == table.columns, name
        table = out.cache()
        got = [(r.doc_id, r.text) for r in table.collect()]
        assert Counter(got) == Counter(docs), name
        assert all(r.n_chars == len(r.text) and r.source == f"s{r.doc_id}" for r in table.collect())
        sizes.append(len(docs))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 10
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    whole = {i: b"".join(int(x).to_bytes(4, "little") for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in docs}
    assert len(whole) == len(docs)
    pieces = corpus_pipeline.run(spark, path).collect()
    for r in pieces:
        part = whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part) and 4 * r.doc_tokens == len(whole[r.doc_id])
    assert sum(r.length for r in pieces) == sum(map(len, whole.values())) // 4
    at = 0
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 4096 + r.offset == at and r.offset + r.length <= 4096
        at += r.length


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "benchmark"):
        queries.load(spark, path, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
