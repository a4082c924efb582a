"""Quality rules, line first: rules judge each line, failing lines go, and documents that lose too much text are rejected.

A line fails if it is
- symbols: over a tenth of its characters are among ``#*$%&|<>``;
- navigation: three or more `` | `` separators, one for every four words or more;
- shouting: 20 or more letters, over 60 % of them capitals;
- punctuation: ten or more words and over a third of its words end in two or more of ``!?``;
- boilerplate: it holds a fixed phrase of page furniture and has under 25 words.
A document is rejected if it is base-failed or if failing lines hold over 30 % of its word characters.

All columns come from one pass over the row, without a shuffle. Cases: a null or wordless text has zeros everywhere and
is base-failed (under ten words); repeated rows are judged alike; extra columns, of any name, pass through ``clean`` untouched; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import passing

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|subscribe to our|click here|sign up|log in|share this|read more|skip to content|enable javascript)"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 10, 20, 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _failing(line: str) -> str:
    """SQL over the string column or variable ``line``."""
    words = f"regexp_count({line}, '[^\\\\x20\\\\x09-\\\\x0D]+')"
    capitals = f"length(regexp_replace({line}, '[^\\\\p{{Lu}}]', ''))"
    letters = f"length(regexp_replace({line}, '[^\\\\p{{L}}]', ''))"
    bars = f"regexp_count({line}, ' [|] ')"
    marks = f"regexp_count({line}, '[!?][!?]+([\\\\x20\\\\x09-\\\\x0D]|$)')"
    return (
        f"10 * regexp_count({line}, '{SYMBOLS}') > length({line}) "
        f"OR ({bars} >= 3 AND 4 * {bars} >= {words}) "
        f"OR ({letters} >= 20 AND 10 * {capitals} > 6 * {letters}) "
        f"OR ({marks} >= 4 AND {words} >= 10 AND 3 * {marks} > {words}) "
        f"OR ({line} RLIKE '{BOILERPLATE}' AND {words} < 25)"
    )


def judged(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and a struct ``__q`` of metrics, verdict and the cleaned text."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    out = out.select(*keep, "__text", words_of(F.col("__text")).alias("__words"), F.split("__text", "\n").alias("__lines"))
    grams = "slice(transform(__words, (w, i) -> xxhash64(w, get(__words, i + 1), get(__words, i + 2), get(__words, i + 3), get(__words, i + 4))), 1, greatest(size(__words) - 4, 0))"
    out = out.select(*keep, "__text", "__lines", F.size("__words").cast("long").alias("__n"), F.expr(grams).alias("__grams"),
                     F.expr("filter(__lines, x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')").alias("__inked"))
    bad = F.expr(f"filter(__inked, x -> {_failing('x')})")
    pairs = "CASE WHEN size(array_distinct(__grams)) < size(__grams) THEN sort_array(transform(__grams, (h, i) -> struct(h, i))) END"
    out = out.select(*keep, "__text", "__lines", "__n", "__inked", bad.alias("__bad"), F.expr(pairs).alias("__pairs"))
    # the places of windows that another window equals, in order
    twice = "sort_array(transform(filter(__pairs, (p, j) -> p.h <=> get(__pairs, j - 1).h OR p.h <=> get(__pairs, j + 1).h), p -> p.i))"
    out = out.select(*keep, "__text", "__lines", "__n", "__inked", "__bad", F.expr(twice).alias("__twice"))
    repeated = F.expr("aggregate(transform(__twice, (p, j) -> CAST(least(5, coalesce(get(__twice, j + 1) - p, 5)) AS BIGINT)), 0L, (a, x) -> a + x)")
    ink = lambda c: F.length(F.regexp_replace(c, SPACE + "+", "")).cast("long")
    metrics = {
        "n_words": F.col("__n"),
        "word_chars": ink(F.col("__text")),
        "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__inked") - F.size(F.array_distinct("__inked"))).cast("long"),
        "n_repeat_words": F.coalesce(repeated, F.lit(0).cast("long")),
        "lost_chars": ink(F.array_join("__bad", " ")),
    }
    return out.select(*keep, "__lines", "__bad", F.struct(*[v.alias(k) for k, v in metrics.items()]).alias("__q"))


def _verdict() -> tuple[Column, Column]:
    q = F.col("__q")
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)
    return failed, ~failed & (100 * q.lost_chars <= MAX_LOST_PERCENT * q.word_chars)


def quality_metrics(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base metrics, lost_chars, base_failed and kept."""
    failed, kept = _verdict()
    return judged(docs.select("doc_id", "text")).select("doc_id", "__q.*", failed.alias("base_failed"), kept.alias("kept"))


@passing
def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with the columns of ``docs``, their text (and n_chars, if there is one) without failing lines."""
    _, kept = _verdict()
    text = F.when(F.size("__bad") > 0, F.array_join(F.expr("filter(__lines, x -> NOT array_contains(__bad, x))"), "\n")).otherwise(F.col("text"))
    # the id is there so that the optimizer leaves the filter above the metrics: pushed down, it would repeat their
    # expressions at every level, which grows without end
    out = judged(docs).withColumn("__place", F.monotonically_increasing_id()).where(kept & (F.col("__place") >= 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_sql() -> str:
    """The same metrics and verdict for DuckDB."""
    space, ink = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    count = lambda s, p: f"length(regexp_extract_all({s}, '{p}'))"
    ws, bars, marks = count("x", ink + "+"), count("x", " [|] "), count("x", r"[!?][!?]+([\x20\x09-\x0D]|$)")
    capitals, letters = (f"length(regexp_replace(x, '[^\\p{{{c}}}]', '', 'g'))" for c in ("Lu", "L"))
    fails = (
        f"10 * {count('x', SYMBOLS)} > length(x) OR ({bars} >= 3 AND 4 * {bars} >= {ws}) OR ({letters} >= 20 AND 10 * {capitals} > 6 * {letters}) "
        f"OR ({marks} >= 4 AND {ws} >= 10 AND 3 * {marks} > {ws}) OR (regexp_matches(x, '{BOILERPLATE}') AND {ws} < 25)"
    )
    chars = lambda s: f"length(regexp_replace({s}, '{space}+', '', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{ink}+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), chr(31)) AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
c AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
p AS (SELECT r, sum(least(5, coalesce(j - i, 5)))::BIGINT AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, x FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{ink}')),
m AS (SELECT r, (count(*) - count(DISTINCT x))::BIGINT AS n_dup_lines, coalesce(sum({chars('x')}) FILTER (WHERE {fails}), 0)::BIGINT AS lost_chars FROM l GROUP BY r),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, {chars('text')}::BIGINT AS word_chars, {count('text', SYMBOLS)}::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
  FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept FROM f"""
