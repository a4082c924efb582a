"""Substring dedup with repeated-phrase automata.

A word goes if it lies in a window of 50 consecutive words whose sequence also starts in a document with a smaller id.

1. Each window is represented by one of its 12-word phrases, the one with the least hash; equal windows choose equal
   phrases at equal places. Phrases that two documents chose are the candidates, about one for twenty words of repeated
   text.
2. The candidates' texts are fetched from the first documents that hold them and dealt into shards of bounded size.
   Each shard is compiled into an Aho-Corasick automaton, which locates every occurrence in the documents streamed
   through it. All documents are surveyed; those that chose none of the shard's phrases hold no window that could be
   repeated by one of them, so they need not stream through that shard. A shard with many documents is compiled
   several times, for parts of them, so a phrase in a third of all documents delays no task.
3. The places that the automaton found are extended to the windows around them that they represent, and these are
   confirmed by 128-bit hashes of their words: the least document of each is kept, later ones lose the words. All
   windows that equal one another represent equal phrases, so a shard of one part confirms its own. Windows of shards in
   several parts are grouped by a shuffle, which combines first; its result is written, so that the join back can split
   a hot window's rows.

Two windows count as equal if they share a phrase, byte for byte, and two independent 64-bit hashes of all their words.

Cases: a null, empty or short text has no windows and loses nothing; rows of one id are one document, each keeping its
own words; null ids come after all others and do not repeat one another; extra columns are ignored; an empty table
gives an empty result; a document's size is not limited.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import Scratch, ship
from kairolog.llm._words import TWIN, U, gram_hashes, sized, sliding_min, split_words, utf8, word_hashes

WINDOW, PHRASE = 50, 12
SHARD_CHARS, PART_BYTES = 1_000_000, 24 << 20
LAST = (1 << 63) - 1  # where null ids stand
NONE = U((1 << 64) - 1)
FOUND = ["window", "twin", "doc", "row", "place", "places"]


class Windows:
    """The words of some documents, their windows, and the phrase that each window chose."""

    def __init__(self, column: pa.Array, window: int, phrase: int, twin: bool = False) -> None:
        self.data, bounds = utf8(column)
        self.start, self.end, self.first = split_words(self.data, bounds)
        words = word_hashes(self.data, self.start, self.end)
        self.grams = gram_hashes(words, phrase)
        self.hashes = gram_hashes(words, window)
        self.twins = gram_hashes(word_hashes(self.data, self.start, self.end, TWIN[0]), window, TWIN[1]) if twin else None
        chosen = sliding_min(self.grams, window - phrase + 1) if len(self.hashes) else self.hashes
        doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.at = np.flatnonzero(np.arange(len(self.hashes)) + window <= self.first[1:][doc[: len(self.hashes)]])
        self.doc, self.chosen = doc[self.at], chosen[self.at]

    def around(self, places: np.ndarray, reach: int) -> np.ndarray:
        """The windows that a phrase at one of the places represents, as indices into ``at``."""
        held = np.full(len(self.grams), NONE)
        held[places] = self.grams[places]
        return np.flatnonzero(sliding_min(held, reach)[self.at] == self.chosen) if len(self.at) else self.at

    def words(self, a: int, b: int) -> list[bytes]:
        body = memoryview(self.data)
        return [bytes(body[x:y]) for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _survey(window: int, phrase: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            w = Windows(batch.column("text"), window, phrase)
            new = np.ones(len(w.at), bool)
            new[1:] = (w.chosen[1:] != w.chosen[:-1]) | (w.doc[1:] != w.doc[:-1])
            doc, chosen = w.doc[new], w.chosen[new].view(np.int64)
            order = np.lexsort((chosen, doc))
            doc, chosen = doc[order], chosen[order]
            once = np.ones(len(doc), bool)
            once[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
            digests = [hashlib.sha256(b" ".join(w.words(a, b))).hexdigest() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", "doc", "row")), pa.array(np.diff(w.first).astype(np.int64)), pa.array(digests), _lists(doc[once], chosen[once], batch.num_rows)],
                ["doc_id", "doc", "row", "n_words", "sha256", "phrases"],
            )

    return run


def _fetch(window: int, phrase: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            w = Windows(batch.column("text"), window, phrase)
            wanted = np.unique(batch.column("own").flatten().to_numpy().view(np.uint64))
            at = np.flatnonzero(np.isin(w.grams, wanted))
            # a run of words over the edge of two documents is no phrase; whole places may follow it
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
            at = at[doc[at] == doc[at + phrase - 1]]
            got, first = np.unique(w.grams[at], return_index=True)
            texts = [b" ".join(w.words(p, p + phrase)) for p in at[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(texts, pa.binary())], ["phrase", "body"])

    return run


def located(automaton: object, words: list[bytes]) -> np.ndarray:
    """The words, by number, at which the automaton's phrases occur in the text. Patterns are its words between single spaces."""
    text = b" ".join([b"", *words, b""])
    ends = np.fromiter((end - length + 1 for end, length in automaton.iter(text.decode("latin-1"))), np.int64)
    spaces = np.cumsum([0, *(len(w) + 1 for w in words)])
    return np.searchsorted(spaces, ends)


class Found:
    """The windows located in one part's documents."""

    def __init__(self) -> None:
        self.docs: list[tuple[int, int]] = []
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, w: Windows, at: np.ndarray, docs: pa.Array, rows: pa.Array) -> None:
        own = w.doc[at]
        used, local = np.unique(own, return_inverse=True)
        self.held.append((w.hashes[w.at[at]], w.twins[w.at[at]], (local + len(self.docs)).astype(np.int32), (w.at[at] - w.first[own]).astype(np.int32)))
        self.docs += zip(docs.take(pa.array(used)).to_pylist(), rows.take(pa.array(used)).to_pylist(), strict=True)

    def rows(self, whole: bool) -> Iterator[pa.RecordBatch]:
        """Of a whole shard, the places to remove by document; else every window."""
        if not self.held:
            return
        window, twin, own, place = (np.concatenate(x) for x in zip(*self.held, strict=True))
        doc, row = (np.array(x, np.int64) for x in zip(*self.docs, strict=True))
        if whole:
            order = np.lexsort((twin, window))
            window, twin, own, place = window[order], twin[order], own[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (twin[1:] != twin[:-1])]))
            least = np.repeat(np.minimum.reduceat(doc[own], new), np.diff([*new, len(own)]))
            gone = np.flatnonzero(doc[own] > least)
            gone = gone[np.argsort(own[gone], kind="stable")]
            used, first = np.unique(own[gone], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array([*first, len(gone)], pa.int32()), pa.array(place[gone]))
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(doc[used]), pa.array(row[used]), none.cast(pa.int32()), lists], FOUND)
        else:
            empty = pa.nulls(len(own), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(twin.view(np.int64)), pa.array(doc[own]), pa.array(row[own]), pa.array(place), empty], FOUND)


def _stream(window: int, phrase: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by part, phrases (kind 0) before documents (1, or 2 in a shard of this part alone): compile, locate, confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        part, automaton, ready, whole, found = None, None, False, False, Found()
        for batch in sized(batches, "body"):
            keys, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                some = batch.slice(lo, hi - lo)
                if keys[lo] != part:
                    yield from found.rows(whole)
                    part, automaton, ready, found = keys[lo], ahocorasick.Automaton(ahocorasick.STORE_LENGTH), False, Found()
                if kinds[lo] == 0:
                    for body in some.column("body").to_pylist():
                        automaton.add_word(f" {body.decode('latin-1')} ")
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready, whole = True, kinds[lo] == 2
                if not len(automaton):
                    continue
                w = Windows(some.column("body"), window, phrase, twin=True)
                places = [a + located(automaton, w.words(a, b)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                at = w.around(np.concatenate(places).astype(np.int64), window - phrase + 1)
                if len(at):
                    found.add(w, at, some.column("doc"), some.column("row"))
                if not whole:
                    yield from found.rows(whole)
                    found = Found()
        yield from found.rows(whole)

    return run


def _remove(window: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            start, end, first = split_words(data, bounds)
            gone, digest, kept = [], [], []
            body = memoryview(data)
            for places, a, b in zip(batch.column("places"), first[:-1], first[1:], strict=True):
                edge = np.zeros(b - a + 1, np.int64)
                at = places.values.to_numpy()  # rows repeated whole bring theirs more than once
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                stay = a + np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                text = b" ".join([bytes(body[x:y]) for x, y in zip(start[stay].tolist(), end[stay].tolist(), strict=True)])
                gone.append(b - a - len(stay)), digest.append(hashlib.sha256(text).hexdigest()), kept.append(text.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc", "row", "gone", "digest", "kept"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_chars: int = SHARD_CHARS, part_bytes: int = PART_BYTES, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per document; with ``texts``, kept_text where words were removed."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring-dedup")
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    survey = scratch.write(keyed.mapInArrow(_survey(window, phrase), f"doc_id {kind}, doc long, row long, n_words long, sha256 string, phrases array<long>"), "survey")
    chosen = survey.select("doc", "row", F.explode("phrases").alias("phrase"))
    repeated = chosen.groupBy("phrase").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("phrase", "first")
    repeated = scratch.write(repeated, "repeated")
    held = chosen.join(repeated, "phrase").groupBy("doc", "row").agg(F.collect_set(F.struct("phrase", "first")).alias("held"))  # no more than a document's words
    suspects = scratch.write(keyed.drop("doc_id").join(held, ["doc", "row"]), "suspects")
    own = suspects.select("text", F.expr("transform(filter(held, h -> h.first = doc), h -> h.phrase)").alias("own")).where("size(own) > 0")
    phrases = own.mapInArrow(_fetch(window, phrase), "phrase long, body binary").dropDuplicates(["phrase"]).join(repeated, "phrase")
    phrases = scratch.write(phrases, "phrases")
    chars = phrases.agg(F.sum(F.length("body") + 2)).first()[0] or 0
    shards = max(1, math.ceil(chars / shard_chars))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    routed = suspects.select("doc", "row", "text", F.explode(F.expr(f"array_distinct(transform(held, h -> pmod(xxhash64(h.first), {shards})))")).alias("shard"))
    load = {r["shard"]: r["n"] for r in routed.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row per shard
    count = np.array([max(1, math.ceil((load.get(s) or 0) / part_bytes)) for s in range(shards)], np.int64)
    parts = spark.createDataFrame(pa.table({"shard": pa.array(range(shards), pa.int64()), "parts": pa.array(count), "base": pa.array(np.cumsum(count) - count)}))
    patterns = phrases.select(shard("first").alias("shard"), "phrase", "body").join(F.broadcast(parts), "shard")
    patterns = patterns.select(F.explode(F.expr("transform(sequence(0L, parts - 1), p -> CAST(base + p AS INT))")).alias("part"), F.lit(0).alias("kind"), F.col("phrase").alias("doc"), F.lit(0).cast("long").alias("row"), "body")
    bodies = routed.join(F.broadcast(parts), "shard").select((F.col("base") + F.pmod(F.xxhash64("doc", "row"), F.col("parts"))).cast("int").alias("part"), F.when(F.col("parts") == 1, 2).otherwise(1).alias("kind"), "doc", "row", F.col("text").cast("binary").alias("body"))
    stream = patterns.union(bodies).repartitionById(int(count.sum()), F.col("part")).sortWithinPartitions("part", "kind")
    found = scratch.write(stream.mapInArrow(_stream(window, phrase), "window long, twin long, doc long, row long, place int, places array<int>"), "windows")
    scratch.drop("phrases", "repeated")
    shared = found.where("places IS NULL").select("window", "twin", "doc", "row", "place")
    confirmed = scratch.write(shared.groupBy("window", "twin").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("window", "twin", "least"), "confirmed")
    gone = shared.join(confirmed, ["window", "twin"]).where("least < doc").groupBy("doc", "row").agg(F.collect_set("place").alias("places"))
    gone = gone.unionByName(found.where("places IS NOT NULL").select("doc", "row", "places")).groupBy("doc", "row").agg(F.flatten(F.collect_list("places")).alias("places"))
    gone = scratch.write(gone, "gone")
    scratch.drop("windows", "confirmed")
    removed = suspects.select("doc", "row", "text").dropDuplicates(["doc", "row"]).join(gone, ["doc", "row"]).mapInArrow(_remove(window, texts), "doc long, row long, gone long, digest string, kept string")
    out = survey.drop("phrases").join(removed, ["doc", "row"], "left")
    columns = ["doc_id", "n_words", F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("digest", "sha256").alias("kept_sha256")]
    return out.select(*columns, *([F.col("kept").alias("kept_text")] if texts else []))


def substring_sql(window: int = WINDOW) -> str:
    """The same rows for DuckDB, from the windows themselves."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS s FROM (SELECT r, k, w, unnest(range(1, greatest(len(w) - {window - 2}, 1))) AS i FROM d)),
f AS (SELECT s, min(k) AS least FROM g GROUP BY s HAVING min(k) < max(k)),
c AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS x FROM (SELECT r, i FROM g JOIN f USING (s) WHERE least < k)),
u AS (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS x FROM d),
l AS (SELECT r, string_agg(v, ' ' ORDER BY x) AS kept FROM u ANTI JOIN c USING (r, x) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (r) LEFT JOIN n USING (r)"""
