"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ten words (an item of fewer words is one window). A window's tokens are its five-word
shingles (all its words, if it has fewer). Containment must be exact, so every token of a window is necessary and a
prefix of one token suffices: the rarest, by how often the documents hold it. A document position with that token
fixes where the window would start (positional bound) and end (length bound); the words there are then compared.

One pass over the texts finds the places of benchmark tokens, with the words around them; all later steps work on that
table. Tokens travel as a literal set while they number at most ``SET_BOUND``, else by a join. All steps are DataFrame
code.

Cases: a null or wordless text has no words and is clean; null or wordless items have no windows; equal windows of
several items count for each; repeated rows get equal results; extra columns, of any name, pass through ``decontaminated``; with no
items every document is clean, with no documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import materialize, passing
from kairolog.llm.url_filters import lower_ascii

WINDOW, SHINGLE, SET_BOUND = 10, 5, 50_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text"):
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _token(words: str, i: str, k: int) -> str:
    """SQL for the hash of k words of the array from place i (from 0)."""
    return f"xxhash64({', '.join(f'get({words}, {i} + {j})' for j in range(k))})"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window: the distinct windows of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("w")).where("size(w) > 0")
    cut = f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))"
    return items.select("item_id", F.explode(F.expr(cut)).alias("window")).distinct()


def window_tokens(windows: DataFrame) -> DataFrame:
    """window, k, offset, token: each shingle of each distinct window."""
    w = windows.select("window").distinct().withColumn("k", F.least(F.size("window"), F.lit(SHINGLE)))
    w = w.select("window", "k", F.explode(F.expr("sequence(0, size(window) - k)")).alias("offset"))
    token = "CASE " + " ".join(f"WHEN k = {k} THEN {_token('window', 'offset', k)}" for k in range(1, SHINGLE + 1)) + " END"
    return w.withColumn("token", F.expr(token))


def occurrences(docs: DataFrame, tokens: DataFrame, window: int = WINDOW, set_bound: int = SET_BOUND) -> DataFrame:
    """doc_id, row, n_words, pos, k, token, left, around: a row with pos -1 per document, and one per benchmark token in it."""
    lengths = sorted(r["k"] for r in tokens.select("k").distinct().collect())  # at most SHINGLE rows
    base = docs.select("doc_id", F.xxhash64("text").alias("row"), words_of().alias("words"))
    found = tokens.select("k", "token").distinct().limit(set_bound + 1).collect()
    places = []
    if len(found) <= set_bound:
        for k in lengths:
            held = ", ".join(f"{r['token']}L" if r["token"] > -(2**63) else "-9223372036854775807L - 1L" for r in found if r["k"] == k)
            places.append(f"transform(filter(transform(words, (w, i) -> IF(i + {k} <= size(words) AND {_token('words', 'i', k)} IN ({held}), i, -1)), i -> i >= 0), i -> struct(i AS pos, {k} AS k))")
    else:
        base = base.where("size(words) >= 0")
        every = [base.select("doc_id", "row", F.lit(k).alias("k"), F.expr(f"posexplode(transform(sequence(0, greatest(size(words) - {k}, 0)), i -> {_token('words', 'i', k)})) AS (pos, token)")) for k in lengths]
        for i, k in enumerate(lengths):
            hit = every[i].join(tokens.where(F.col("k") == k).select("token").distinct(), "token").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("p"))
            hit = hit.select(F.col("doc_id").alias(f"id{k}"), F.col("row").alias(f"row{k}"), F.col("p").alias(f"p{k}"))
            base = base.join(hit, F.col("doc_id").eqNullSafe(F.col(f"id{k}")) & (F.col("row") == F.col(f"row{k}")), "left")
            places.append(f"transform(filter(coalesce(p{k}, array()), i -> i + {k} <= size(words)), i -> struct(i AS pos, {k} AS k))")
    spots = f"flatten(array(array(struct(-1 AS pos, 0 AS k)){''.join(', ' + p for p in places)}))"
    out = base.select("doc_id", "row", "words", F.explode(F.expr(spots)).alias("spot"))
    left = f"least(spot.pos, {window} - spot.k)"
    token = "CASE " + " ".join(f"WHEN spot.k = {k} THEN {_token('words', 'spot.pos', k)}" for k in range(1, SHINGLE + 1)) + " END"
    return out.select(
        "doc_id", "row", F.size("words").cast("long").alias("n_words"), "spot.pos", "spot.k", F.expr(token).alias("token"),
        F.expr(left).alias("left"), F.expr(f"IF(spot.pos < 0, array(), slice(words, spot.pos - {left} + 1, {left} + {window}))").alias("around"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_bound: int = SET_BOUND) -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated for each document; row tells texts of one id apart."""
    items = materialize(item_windows(benchmark, window), "decontamination-items")
    tokens = materialize(window_tokens(items), "decontamination-tokens")
    seen = materialize(occurrences(docs, tokens, window, set_bound), "decontamination-places")
    counts = seen.where("pos >= 0").groupBy("k", "token").agg(F.count("*").alias("n"))
    # a window with a token that no document holds occurs nowhere
    ranked = tokens.join(counts, ["k", "token"], "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset", "k")).alias("rarest")).where("rarest.n > 0")
    prefix = ranked.select("window", "rarest.token", "rarest.offset", "rarest.k")
    hits = seen.where("pos >= 0").join(prefix, ["k", "token"]).where("left >= offset AND left - offset + size(window) <= size(around)")
    hits = hits.where(F.expr("slice(around, left - offset + 1, size(window)) = window"))
    hits = hits.select("doc_id", "row", F.struct((F.col("pos") - F.col("offset")).alias("a"), F.size("window").alias("n")).alias("span"), "window")
    per = hits.join(items, "window").groupBy("doc_id", "row").agg(F.collect_set("span").alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    union = "aggregate(sort_array(spans), named_struct('n', 0, 'end', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.a + x.n - greatest(s.end, x.a)), 'end', greatest(s.end, x.a + x.n)), s -> s.n)"
    per = per.select(F.col("doc_id").alias("id"), F.col("row").alias("hit_row"), F.expr(union).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = seen.where("pos < 0").join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("hit_row")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "row", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


@passing
def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__row")), "left_anti")


def decontamination_sql(window: int = WINDOW) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(list_slice(w, a, a + {window - 1}), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS a FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM i),
p AS (SELECT r, n, a, array_to_string(list_slice(w, a, a + n - 1), ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, n WHERE len(w) >= n)),
h AS (SELECT r, a, p.n, item_id FROM p JOIN i USING (s, n)),
c AS (SELECT r, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
