"""Line dedup over content-defined chunks.

A document's lines get hashes; a rolling hash over two lines makes every second one, on average, a candidate for the end
of a chunk, and a chunk ends at the first candidate after its first line. So every chunk but the last has two lines at
least, and an inserted line moves only the boundaries near it. A chunk of two or more lines with words that stands in
the corpus more than once, byte for byte, is removed everywhere but at its first place (least doc_id, then text
checksum, then line).

Equal bytes are established by grouping on the chunk itself; its two digests only carry the decision back, and digests
that two different chunks share decide nothing. Both groupings combine before they shuffle, so a chunk in a third of all
documents costs one row per task; the repeated digests are written, so that the join back can split a hot one's rows.
All steps are DataFrame code.

Cases: a null text stays null; an empty one stays empty; rows repeated whole stand in one place and all keep what it
keeps; a null id sorts before the others; extra columns, of any name, pass through; an empty table gives an empty
result. A line is what stands between ``\\n``.

Chunks leave what of a repeated block stands before its first boundary and after its last: the rule of ``line_dedup`` and
its SQL. ``run_dedup``, which the pipeline takes, leaves none of a repeated run of two or more lines with words. Each pair
of successive lines with words (and blank lines between) is removed everywhere but at its first place, so all of a run
goes at every place but the first of its pairs, and no line loses its first place. Pairs are told apart by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import Scratch, passing

ONE_IN, FACTOR = 2, 31
MIN_LINES = 2
CHUNK = "(.+?)1"  # over flags of candidates: the shortest stretch of two lines or more that ends in one
ROW = ["doc_id", "__row"]


def chunked(docs: DataFrame) -> DataFrame:
    """The rows with ``__row`` (tells texts of one id apart), ``__lines`` and ``__ends``: the last line of each chunk."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*keep, F.xxhash64("text").alias("__row"), F.split("text", "\n").alias("__lines"))
    out = out.select(*keep, "__row", "__lines", F.expr("transform(__lines, x -> CAST(conv(substr(md5(CAST(x AS BINARY)), 1, 8), 16, 10) AS BIGINT))").alias("__h"))
    flags = F.expr(f"array_join(transform(__h, (h, i) -> IF((h * {FACTOR} + coalesce(get(__h, i - 1), 0)) % {ONE_IN} = 0, '1', '0')), '')")
    out = out.select(*keep, "__row", "__lines", F.split(F.regexp_replace(flags, CHUNK, "$1E"), "").alias("__marks"))
    return out.select(*keep, "__row", "__lines", F.expr("filter(transform(__marks, (m, i) -> IF(m = 'E' OR i = size(__lines) - 1, i, -1)), i -> i >= 0)").alias("__ends"))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id, __row, first (its first line), chunk: for each chunk of enough lines with words."""
    out = chunked(docs.select("doc_id", "text"))
    spans = "transform(__ends, (e, j) -> struct(coalesce(get(__ends, j - 1), -1) + 1 AS first, e AS last))"
    out = out.select(*ROW, "__lines", F.expr(f"filter({spans}, s -> s.last - s.first >= {MIN_LINES - 1})").alias("__spans"))
    inked = f"size(filter(c.lines, x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')) >= {MIN_LINES}"
    cut = f"filter(transform(__spans, s -> struct(s.first AS first, slice(__lines, s.first + 1, s.last - s.first + 1) AS lines)), c -> {inked})"
    return out.select(*ROW, F.expr(f"inline(transform({cut}, c -> struct(c.first AS first, array_join(c.lines, '\\n') AS chunk)))"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, __row, __first: an array of the first lines of the chunks to remove. Rows without any are missing."""
    digests, place = ["digest", "twin"], F.struct("doc_id", "__row", "first")
    rows = chunk_rows(docs).select("*", F.unhex(F.md5(F.col("chunk").cast("binary"))).alias("digest"), F.xxhash64("chunk").alias("twin"))
    same = rows.groupBy(*digests, "chunk").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    known = same.groupBy(*digests).agg(F.count("*").alias("texts"), F.first("n").alias("n"), F.first("at").alias("at"))
    known = Scratch(docs.sparkSession, "line-dedup").write(known.where("texts = 1 AND n > 1").select(*digests, "at"), "repeated")
    later = rows.drop("chunk").join(known, digests).where(~place.eqNullSafe(F.col("at")))
    # equal rows (same id and text) hold the same places: see line_dedup
    return later.groupBy(*ROW).agg(F.collect_set("first").alias("__first"))


@passing
def line_dedup(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with text (and n_chars, if there is one) without the repeated chunks."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    gone = removals(docs).select(F.col("doc_id").alias("__id"), F.col("__row").alias("__gone_row"), "__first")
    out = chunked(docs)
    out = out.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__gone_row")), "left")
    spans = "transform(__ends, (e, j) -> struct(coalesce(get(__ends, j - 1), -1) + 1 AS first, e AS last))"
    lines = f"flatten(transform(filter({spans}, s -> NOT array_contains(__first, s.first)), s -> slice(__lines, s.first + 1, s.last - s.first + 1)))"
    out = out.withColumn("text", F.when(F.col("__first").isNull(), F.col("text")).otherwise(F.array_join(F.expr(lines), "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__first").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def pair_rows(docs: DataFrame) -> DataFrame:
    """doc_id, __row, first, last, digest: for each pair of successive lines with words."""
    out = docs.select("doc_id", F.xxhash64("text").alias("__row"), F.split("text", "\n").alias("__lines"))
    inked = "filter(transform(__lines, (x, i) -> IF(x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]', i, -1)), i -> i >= 0)"
    out = out.select(*ROW, "__lines", F.expr(inked).alias("__inked"))
    out = out.select(*ROW, "__lines", F.expr("inline(transform(slice(__inked, 2, size(__inked)), (b, j) -> struct(__inked[j] AS first, b AS last)))"))
    return out.select(*ROW, "first", "last", F.unhex(F.sha2(F.expr("array_join(slice(__lines, first + 1, last - first + 1), '\n')").cast("binary"), 256)).alias("digest"))


@passing
def run_dedup(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with text (and n_chars, if there is one) without the repeated runs of lines."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows, place = pair_rows(docs), F.struct("doc_id", "__row", "first")
    known = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("at")).where("n > 1").select("digest", "at")
    gone = rows.join(known, "digest").where(~place.eqNullSafe(F.col("at"))).groupBy(*ROW).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("__pairs"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__gone_row"), "__pairs")
    out = docs.select(*names, F.xxhash64("text").alias("__row"))
    out = out.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__gone_row")), "left")
    # what stands before the first pair and after each one up to the next
    after = "flatten(transform(__pairs, (p, j) -> slice(__lines, p.last + 2, greatest(coalesce(get(__pairs, j + 1).first, size(__lines)) - p.last - 1, 0))))"
    out = out.withColumn("__lines", F.when(F.col("__pairs").isNotNull(), F.split("text", "\n")))
    lines = F.concat(F.expr("slice(__lines, 1, __pairs[0].first)"), F.expr(after))
    out = out.withColumn("text", F.when(F.col("__pairs").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__pairs").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept_lines, kept_sha256 of each document's text after the removal."""
    out = line_dedup(docs.select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("before")))
    count = F.coalesce(F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))), F.lit(0)).cast("long")
    before = F.when(F.col("before") < 0, F.lit(0)).otherwise(F.col("before")).cast("long")
    return out.select("doc_id", F.coalesce(before, F.lit(0).cast("long")).alias("n_lines"), count.alias("n_kept_lines"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def line_dedup_sql() -> str:
    h = "('0x' || substr(md5(x), 1, 8))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, i, x, {h} AS h FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL)),
f AS (SELECT *, (h * {FACTOR} + coalesce(lag(h) OVER (PARTITION BY r ORDER BY i), 0)) % {ONE_IN} = 0 AS cand FROM l),
m AS (SELECT r, regexp_replace(string_agg(CASE WHEN cand THEN '1' ELSE '0' END, '' ORDER BY i), '{CHUNK}', '\\1E', 'g') AS marks FROM f GROUP BY r),
e AS (SELECT f.*, substr(marks, i::INT + 1, 1) = 'E' AS ends FROM f JOIN m USING (r)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
c AS (SELECT r, doc_id, c, min(i) AS a, string_agg(x, chr(10) ORDER BY i) AS chunk, count(*) AS n, count(*) FILTER (WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS inked FROM k GROUP BY r, doc_id, c),
o AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS nth FROM c WHERE n >= {MIN_LINES} AND inked >= {MIN_LINES}),
t AS (SELECT k.r, string_agg(x, chr(10) ORDER BY i) AS kept, count(*) AS n FROM k LEFT JOIN o ON o.r = k.r AND o.c = k.c AND o.nth > 1 WHERE o.r IS NULL GROUP BY k.r)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(CASE WHEN kept = '' THEN 0 ELSE t.n END, 0)::BIGINT AS n_kept_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)"""
