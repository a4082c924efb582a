"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles (all its words, if it has one to four). Documents with equal sets form a
class, and one set stands for it. In each of several runs every set picks shared-random tokens, ``BRANCH`` on average,
and goes into a bucket for each; buckets of more than ``SMALL`` sets are split again along further tokens, unless
their sets are so alike that a split doesn't shrink them; the rest is compared by brute force within the bucket, large
ones in blocks of bounded size. ``runs_for`` gives the number of runs for the target recall of pairs at the threshold.

Before tokens travel, a bucket's sets are screened by their sizes and odd sketches: a bit map, of about one bit for a
token, in which every token flips one bit. A token that two sets don't share flips at most one bit of the difference,
so two sketches differ in no more bits than the sets in tokens, and what the similarity allows there is known from the
sizes: the screen loses no pair. Only sets with a possible partner in a bucket go on; buckets that then hold the same
sets are compared once. Token lists never travel: texts do, which are shorter, and only those that a split or a
comparison asks for; a bit map of the wanted ones sifts them before they are dealt, so few others go along.

A pair counts in the least bucket that it shares, so its link is counted once without any table of pairs: each
comparison returns a row per set, with its number of links, weighted by class sizes, and the group that it is
connected to. Groups of different buckets are then merged by their least id.

Cases: null or wordless texts have no shingles, no links, and are their own class; repeated rows and copies are
links of one another; rows of one id are told apart by their texts; null ids come after all others, and a class of null
ids alone has a null class_id; extra columns, of any name, pass through ``one_of_each``; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import Scratch, fresh, ship
from kairolog.llm._words import U, gram_hashes, mix, sized, split_words, utf8, word_hashes

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
BRANCH, SMALL, BLOCK, DEPTH, ALIKE = 3.0, 512, 1024, 4, 0.5
COLUMNS, ROWS = 2048, 256
SKETCHED, CELLS = U(0xA0761D6478BD642F), 1 << 21
SIFT, MOST = 16, 1 << 27  # bits for a wanted row, and in all


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, branch: float = BRANCH, depth: int = DEPTH) -> int:
    """Runs so that a pair at the threshold shares a leaf with that probability: each level is a branching process."""
    survive = 1.0
    for _ in range(depth):
        survive = 1 - math.exp(-branch * threshold * survive)
    return math.ceil(math.log(1 - recall) / math.log(1 - survive))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' distinct shingle hashes, ascending in each, and where each begins, and the end."""
    data, bounds = utf8(column)
    start, end, first = split_words(data, bounds)
    words, count = word_hashes(data, start, end), np.diff(first)
    grams = gram_hashes(words, k)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(np.arange(len(grams)) + k <= first[1:][doc[: len(grams)]])
    doc, grams = doc[at], grams[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        doc = np.concatenate([doc, short])
        grams = np.concatenate([grams, [gram_hashes(words[first[i] : first[i + 1]], count[i])[0] for i in short]])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def chosen(paths: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens continue their path, and the new paths of those."""
    draw = mix(mix(paths + U(0x632BE59BD9B4E019)) ^ tokens)
    picked = np.flatnonzero(draw < (np.minimum(branch / sizes, 1) * float(2**64 - 2**11)).astype(U))
    return picked, mix(draw[picked] ^ U(0x5851F42D4C957F2D))


def sketches(sets: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The odd sketch of each set: as many bits as the next power of two, 64 at least."""
    size = np.diff(ends)
    bits = 1 << np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64)
    begin = np.cumsum(bits) - bits
    at = np.repeat(begin, size) + (mix(sets ^ SKETCHED) & (np.repeat(bits, size) - 1).astype(U)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    body, offsets = np.packbits(odd, bitorder="little"), np.concatenate([[0], np.cumsum(bits // 8)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())


def _survey(k: int, runs: int, branch: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            sets, ends = shingle_sets(batch.column("text"), k)
            size = np.diff(ends)
            owner = np.repeat(np.arange(len(size)), size)
            sums = np.zeros((len(size), 2), U)
            for j, salt in enumerate((0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)):
                total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ U(salt)))])
                sums[:, j] = total[ends[1:]] - total[ends[:-1]]
            docs, paths = [], []
            for r in range(runs):
                at, new = chosen(np.full(len(sets), r + 1, U), sets, size[owner].astype(float), branch)
                docs.append(owner[at]), paths.append(new)
            docs, paths = np.concatenate(docs), np.concatenate(paths)
            order = np.argsort(docs, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(docs[order], np.arange(len(size) + 1)), pa.int32()), pa.array(paths[order].view(np.int64)))
            keys = pa.array([x.tobytes() for x in sums], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), keys, pa.array(size.astype(np.int64)), lists, sketches(sets, ends)], ["doc_id", "at", "key", "n", "paths", "sketch"])

    return run


def _split(k: int, branch: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text goes on from each of its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            sets, ends = shingle_sets(batch.column("text"), k)
            size = np.diff(ends)
            owner = np.repeat(np.arange(len(size)), size)
            paths, count = batch.column("paths").flatten().to_numpy().view(U), batch.column("paths").value_lengths().to_numpy()
            begin = np.cumsum(count) - count
            for turn in range(count.max()):  # a path of each text at a time, so that memory is bounded
                held = count[owner] > turn
                who = owner[held]
                parent = paths[begin[who] + turn]
                at, new = chosen(parent, sets[held], size[who].astype(float), branch)
                yield pa.RecordBatch.from_arrays([pa.array(parent[at].view(np.int64)), pa.array(new.view(np.int64)), batch.column("key").take(pa.array(who[at]))], ["parent", "path", "key"])

    return run


def partners(sets: list[bytes], size: np.ndarray, side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which sets may have the similarity to another one of them (of another side), by sizes and sketches."""
    order = np.argsort(size, kind="stable")
    size, side = size[order], None if side is None else side[order]
    width = np.array([len(sets[i]) for i in order])
    found = np.zeros(len(order), bool)
    for w in np.unique(width).tolist():  # sizes ascend, so each width is a stretch; the next one is folded to it
        a, b = np.searchsorted(width, [w, w + 1])
        c = np.searchsorted(width, 2 * w + 1)
        words = w // 8
        rows = np.frombuffer(b"".join([sets[i] for i in order[a:b]]), U).reshape(b - a, words)
        wide = np.frombuffer(b"".join([sets[i] for i in order[b:c]]), U).reshape(c - b, 2, words)
        all_rows = np.concatenate([rows, wide[:, 0] ^ wide[:, 1]])
        step = max(1, CELLS // ((c - a) * words))
        for lo in range(a, b, step):
            hi = min(b, lo + step)
            last = min(c, int(np.searchsorted(size, size[hi - 1] / threshold + 1e-6, side="right")))
            differ = np.bitwise_count(all_rows[lo - a : hi - a, None, :] ^ all_rows[None, lo - a : last - a, :]).sum(2, dtype=np.int64)
            both = size[lo:hi, None] + size[None, lo:last]
            yes = (differ <= both * ((1 - threshold) / (1 + threshold)) + 1e-6) & (size[None, lo:last] * threshold <= size[lo:hi, None] + 1e-6)
            yes &= np.arange(lo, hi)[:, None] < np.arange(lo, last)[None, :]
            if side is not None:
                yes &= side[lo:hi, None] != side[None, lo:last]
            found[lo:hi] |= yes.any(1)
            found[lo:last] |= yes.any(0)
    out = np.zeros(len(order), bool)
    out[order] = found
    return out


def _screen(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by bucket and pair of blocks; those with a possible partner go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def judged() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            side = rows["block"].to_numpy() if rows["i"][0] != rows["j"][0] else None
            yes = partners(rows["sketch"].to_pylist(), rows["n"].to_numpy(), side, threshold)
            held.clear()
            return rows.drop_columns(["n", "sketch"]).filter(pa.array(yes))

        out: list[pa.Table] = []
        for batch in batches:
            path, i, j = (batch.column(k).to_numpy() for k in ("path", "i", "j"))
            cuts = [0, *(np.flatnonzero((path[1:] != path[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and any(held[0].column(k)[0] != batch.column(k)[lo] for k in ("path", "i", "j")):
                    out.append(judged())
                held.append(batch.slice(lo, hi - lo))
            if len(out) > 1000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if held:
            out.append(judged())
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def shared(values: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share, over ``COLUMNS`` values at a time so that memory is bounded."""
    m = len(values)
    flat, owner = np.concatenate(values), np.repeat(np.arange(m), list(map(len, values)))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(new) - 1
    twice = np.bincount(number)[number] > 1 if len(flat) else new
    number = np.cumsum(new & twice)[twice] - 1
    owner, shares = owner[twice], np.zeros((m, m), np.float32)
    edges = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + COLUMNS, COLUMNS))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if lo < hi:
            grid = np.zeros((m, min(COLUMNS, number[hi - 1] + 1 - i * COLUMNS)), np.float32)
            grid[owner[lo:hi], number[lo:hi] - i * COLUMNS] = 1
            shares += grid @ grid.T
    return shares


def linked(tokens: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have the similarity, by counts of shared tokens."""
    m, size = len(tokens), np.array(list(map(len, tokens)))
    if m == 2:
        both = len(np.intersect1d(*tokens, assume_unique=True))
        yes = both >= threshold * (size.sum() - both) - 1e-9
        return np.array([[False, yes], [yes, False]])
    shares = shared(tokens)
    out = by_rows(m, lambda r: shares[r] >= threshold * (size[r, None] + size[None, :] - shares[r]) - 1e-6)
    np.fill_diagonal(out, False)
    return out


def by_rows(m: int, f: Callable[[slice], np.ndarray]) -> np.ndarray:
    """f over the m rows of a matrix, some at a time: wide temporaries of the whole would outweigh it."""
    return np.concatenate([f(slice(a, a + ROWS)) for a in range(0, m, ROWS)])


def _verify(threshold: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by bucket and pair of blocks; each group is compared once it is complete."""
    label = pa.struct([("nul", pa.bool_()), ("doc", pa.int64()), ("row", pa.int64())])

    def compare(group: list[tuple]) -> list[tuple]:
        path, i, j = group[0][0]
        yes = linked([g[4] for g in group], threshold)
        side = np.array([g[5] for g in group])
        if i != j:
            yes &= side[:, None] != side[None, :]
        if not yes.any():
            return []
        less = [g[6][g[6] < path] for g in group]
        count = yes & (shared(less) == 0) if any(map(len, less)) else yes
        copies = np.array([g[2] for g in group], np.int64)
        links = by_rows(len(group), lambda r: count[r] @ copies)
        names = sorted({g[3] for g in group})
        number = {name: x for x, name in enumerate(names)}
        least = np.array([number[g[3]] for g in group])
        while True:  # every pass carries the least id one link further
            low = np.minimum(least, by_rows(len(group), lambda r, ids=least: np.where(yes[r], ids[None, :], len(names)).min(1)))
            if (low == least).all():
                break
            least = low
        return [(g[1], int(links[x]), names[least[x]]) for x, g in enumerate(group) if yes[x].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def write() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([dict(zip(("nul", "doc", "row"), x[2], strict=True)) for x in out], label)], ["key", "links", "least"])
            out.clear()
            return batch

        for batch in sized(batches, "text"):
            get = {name: batch.column(name) for name in batch.schema.names}
            sets, ends = shingle_sets(get["text"], k)
            groups = zip(*(get[name].to_pylist() for name in ("path", "i", "j", "nul", "doc", "row")), strict=True)
            for x, (path, i, j, *name) in enumerate(groups):
                head = (path, i, j)
                if held and held[0][0] != head:
                    out += compare(held)
                    held = []
                held.append((head, get["key"][x].as_py(), get["copies"][x].as_py(), tuple(name), sets[ends[x] : ends[x + 1]], get["block"][x].as_py(), get["leaves"][x].values.to_numpy()))
            if len(out) > 50_000:
                yield write()
        if held:
            out += compare(held)
        if out:
            yield write()

    return run


def _buckets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count("*").alias("members"))


def leaves(scratch: Scratch, keyed: DataFrame, classes: DataFrame, large: DataFrame, shingle: int, branch: float = BRANCH, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """path, key, members: the sets in each bucket that is to be compared. ``large``: path, key, members of level 1."""
    done = large.limit(0)
    for level in range(2, depth + 1):
        if large.isEmpty():
            break
        parents = large.select("path", "members").distinct().select(F.col("path").alias("parent"), F.col("members").alias("before"))
        asked = large.groupBy("key").agg(F.collect_list("path").alias("paths"))  # a bounded number for each set
        asked = scratch.write(asked.join(classes.select("key", "at.*"), "key"), f"asked-{level}")
        below = scratch.write(fetched(keyed, asked).select("paths", "key", "text").mapInArrow(_split(shingle, branch), "parent long, path long, key binary"), f"level-{level}")
        scratch.drop(f"asked-{level}")
        size = below.groupBy("parent", "path").agg(F.count("*").alias("members"))
        dense = size.groupBy("parent").agg(F.max("members").alias("most")).join(parents, "parent").where(F.col("most") > ALIKE * F.col("before")).select("parent")
        stay = large.join(dense.select(F.col("parent").alias("path")), "path", "left_semi").select("path", "key", "members", F.lit(True).alias("done"))
        size = size.where("members > 1").join(dense, "parent", "left_anti")
        split = below.join(size, ["parent", "path"]).select("path", "key", "members", (F.col("members") <= small).alias("done"))
        rows = scratch.write(split.unionByName(stay), f"split-{level}")
        scratch.drop(f"level-{level}")
        done, large = done.unionByName(rows.where("done").drop("done")), rows.where("NOT done").drop("done")
    return done.unionByName(large).select("path", "key", "members")


def screened(leaf: DataFrame, sketch: DataFrame, threshold: float, block: int) -> DataFrame:
    """path, i, j, block, key: of each bucket and pair of its blocks, the sets with a possible partner there."""
    parts = f"CAST(ceil(members / {block}) AS INT)"
    rows = leaf.select("path", "key", F.expr(f"CAST(pmod(xxhash64(key), {parts}) AS INT)").alias("block"), F.expr(parts).alias("blocks"))
    rows = rows.join(sketch.select("key", "n", "sketch"), "key")
    rows = rows.select("path", "key", "block", "n", "sketch", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    rows = rows.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "sketch")
    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_screen(threshold), "path long, i int, j int, block int, key binary")


def sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that may agree with a wanted one in its columns: all that do, and few others.

    What travels is a bit map of hashes, of ``MOST`` bits at most; a fuller map lets more others through, and loses none."""
    bits = min(MOST, 1 << max(16, (SIFT * wanted.count()).bit_length()))
    (place,) = fresh(rows, "place")
    hashed = F.expr(f"pmod(xxhash64({', '.join(wanted.columns)}), {bits}L) + 1")
    maps = wanted.select(hashed.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap"))
    at = f"bitmap_bit_position(rows.{place})"
    byte = f"CAST(conv(hex(substring(maps.bitmap, CAST({at} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    held = F.expr(f"maps.bucket = bitmap_bucket_number(rows.{place}) AND getbit({byte}, CAST({at} % 8 AS INT)) = 1")
    return rows.withColumn(place, hashed).alias("rows").join(F.broadcast(maps.alias("maps")), held, "left_semi").select(*(F.col(f"rows.{c}") for c in rows.columns))


def fetched(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the texts that their nul, doc and row name; documents repeated whole are one text."""
    place = ["nul", "doc", "row"]
    return sifted(keyed.select("at.*", "text"), rows.select(place).distinct()).dropDuplicates(place).join(rows, place)


def components(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """key, least: the least id of everything reached, from (key, least) rows that each tie a key to a group's least id."""
    names = rows.groupBy("key").agg(F.min("least").alias("least"))
    for turn in range(1 << 20):
        # ids of groups that a key ties together take the least of them, then keys follow
        moved = rows.join(names.withColumnRenamed("least", "low"), "key").groupBy("least").agg(F.min("low").alias("low"))
        after = scratch.write(rows.join(moved, "least").groupBy("key").agg(F.min("low").alias("least")), f"groups-{turn}")
        changed = after.join(names.withColumnRenamed("least", "was"), "key").where("least < was")
        done = changed.isEmpty()
        if turn:
            scratch.drop(f"groups-{turn - 1}")
        names = after
        if done:
            break
    return names


def joined(docs: DataFrame, threshold: float, shingle: int, recall: float, branch: float, small: int, block: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, at, key, n), and one per distinct set (key, copies, links, least); ``least`` is the ``at`` of the group's first document."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = runs_for(recall, threshold, branch, depth)
    number = F.col("doc_id").cast("long")
    at = F.struct(number.isNull().alias("nul"), F.coalesce(number, F.lit(0)).alias("doc"), F.xxhash64("text").alias("row"))
    keyed = docs.select("doc_id", at.alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    place = "struct<nul:boolean,doc:bigint,row:bigint>"
    survey = scratch.write(keyed.mapInArrow(_survey(shingle, runs, branch), f"doc_id {kind}, at {place}, key binary, n long, paths array<long>, sketch binary"), "survey")
    classes = survey.where("n > 0").groupBy("key", "n").agg(F.count("*").alias("copies"), F.min("at").alias("at"), F.min("paths").alias("paths"), F.min("sketch").alias("sketch"))
    classes = scratch.write(classes, "classes")
    first = classes.select(F.explode("paths").alias("path"), "key")
    first = scratch.write(first.join(_buckets(first).where("members > 1"), "path"), "first")
    tight = scratch.write(screened(first.where(F.col("members") <= small), classes, threshold, block), "tight")
    large = first.where(F.col("members") > small)
    rows = tight
    if not large.isEmpty():
        rows = scratch.write(tight.unionByName(screened(leaves(scratch, keyed, classes, large, shingle, branch, small, depth), classes, threshold, block)), "screened")
        scratch.drop("tight", *(f"split-{level}" for level in range(2, depth + 1)))
    scratch.drop("first")
    held = rows.select("path", "key").distinct()
    same = held.groupBy("path").agg(F.count("*").alias("size"), *(F.sum(F.xxhash64("key", F.lit(x)).cast("decimal(38,0)")).alias(f"sum{x}") for x in (0, 1))).groupBy("size", "sum0", "sum1").agg(F.min("path").alias("path"))
    rows = scratch.write(rows.join(same.select("path"), "path"), "compared")
    own = rows.select("key", "path").groupBy("key").agg(F.collect_set("path").alias("leaves"))  # a bounded number for each set
    placed = scratch.write(rows.join(own, "key").join(classes.select("key", "copies", "at.*"), "key"), "placed")
    scratch.drop("compared", "tight", "screened")
    found = fetched(keyed, placed).repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_verify(threshold, shingle), f"key binary, links long, least {place}")
    found = scratch.write(found, "found")
    scratch.drop("placed")
    links = found.groupBy("key").agg(F.sum("links").alias("links")).join(components(scratch, found.select("key", "least").distinct()), "key")
    return survey, classes.select("key", "copies", "at").join(links, "key", "left").select("key", "copies", "links", F.coalesce("least", "at").alias("least"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, branch: float = BRANCH, small: int = SMALL, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """doc_id, row, class_id (least id of the connected group), n_links (documents with the similarity), n_shingles."""
    survey, sets = joined(docs, threshold, shingle, recall, branch, small, block, depth)
    out = survey.select("doc_id", "at.row", "key", "n").join(sets.select("key", "copies", "links", "least"), "key", "left")
    class_id = F.when(F.col("n") == 0, F.col("doc_id")).when(~F.col("least.nul"), F.col("least.doc")).cast("long")
    n_links = F.when(F.col("n") == 0, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    return out.select("doc_id", "row", class_id.alias("class_id"), n_links.alias("n_links"), F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, branch: float = BRANCH, small: int = SMALL, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """One row of ``docs`` for each group, the least by id and text hash, and all rows without words."""
    survey, sets = joined(docs, threshold, shingle, recall, branch, small, block, depth)
    lead = sets.select(F.col("least").alias("at")).distinct()
    times = survey.groupBy("at").agg(F.count("*").alias("times"), F.max("n").alias("words"))
    a, b, c, d = fresh(docs, "nul", "doc", "row", "times")
    kept = times.join(lead, "at", "left_semi").unionByName(times.where("words = 0").withColumn("times", F.lit(1).cast("long")))
    kept = kept.select(F.col("at.nul").alias(a), F.col("at.doc").alias(b), F.col("at.row").alias(c), F.col("times").alias(d))
    number = F.col("doc_id").cast("long")
    names = [F.col(f"`{x}`") for x in docs.columns]
    rows = docs.select(*names, number.isNull().alias(a), F.coalesce(number, F.lit(0).cast("long")).alias(b), F.xxhash64("text").alias(c)).join(kept, [a, b, c])
    # rows that agree in id and text are one document: the first of them stays
    return rows.where(F.col(d) == 1).unionByName(rows.where(F.col(d) > 1).dropDuplicates([a, b, c])).select(*names)


def jaccard_sql(shingle: int = SHINGLE) -> str:
    """The same rows for DuckDB, at a threshold of 4/5: all pairs of distinct sets that share a shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {shingle - 1}), ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
t AS (SELECT s, row_number() OVER () AS token FROM (SELECT DISTINCT s FROM g)),
k AS (SELECT r, list(token ORDER BY token) AS tokens FROM g JOIN t USING (s) GROUP BY r),
q AS (SELECT tokens, row_number() OVER () AS c, len(tokens) AS n FROM (SELECT DISTINCT tokens FROM k)),
m AS (SELECT r, doc_id, c, n FROM d JOIN k USING (r) JOIN q USING (tokens)),
z AS (SELECT c, count(*) AS copies, min(doc_id) AS low FROM m GROUP BY c),
x AS (SELECT c, n, unnest(tokens) AS token FROM q),
e AS (SELECT a, b FROM (SELECT x.c AS a, y.c AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM x JOIN x AS y ON x.token = y.token AND x.c <> y.c AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY ALL) WHERE 5 * shared >= 4 * (na + nb - shared)),
h AS (SELECT c, c AS other FROM q UNION SELECT h.c, e.b FROM h JOIN e ON h.other = e.a),
o AS (SELECT h.c, min(low) AS class_id FROM h JOIN z ON h.other = z.c GROUP BY h.c),
p AS (SELECT a AS c, sum(copies) AS links FROM e JOIN z ON e.b = z.c GROUP BY a)
SELECT d.doc_id, CASE WHEN m.r IS NULL THEN d.doc_id ELSE class_id END::BIGINT AS class_id, coalesce(copies - 1 + coalesce(links, 0), 0)::BIGINT AS n_links, coalesce(m.n, 0)::BIGINT AS n_shingles
FROM d LEFT JOIN m USING (r) LEFT JOIN z USING (c) LEFT JOIN o USING (c) LEFT JOIN p USING (c)"""
