"""URL filters: host/path rules, and pattern rules found through their rarest literal token.

Pattern rules are regular expressions, given as a list or a table. The literal tokens that every match of one must hold
are derived from the pattern (``literal_tokens``). Each rule is filed under the one of them that the fewest distinct URLs
hold; a URL's tokens fetch the rules filed under them, and only those rules run their expression. A rule without such a
token is filed under the empty one, which every URL fetches. Everything is DataFrame code; the rules and their counts
are what the driver holds.

Cases: a null URL, or one without ``://``, has empty host and path, meets no host rule and is allowed unless a pattern
matches it. Repeated URLs share one judgement; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _parser as regex  # the syntax tree of a pattern
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    """A pattern over the URL with A-Z lower-cased, in the syntax that Java, RE2 and Python share."""

    name: str
    pattern: str


HOST_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)

PATTERN_RULES = (
    PatternRule("spam farm", r"://([^/?#]*[.])?spam-farm[.]"),
    PatternRule("pill shop", r"://([^/?#]*[.])?cheap-pills[.]"),
    PatternRule("casino host", r"://([^/?#]*[.-])?casino[.-]"),
    PatternRule("login page", r"://[^?#]*/login([/?#.]|$)"),
    PatternRule("cart page", r"://[^?#]*/cart([/?#.]|$)"),
    PatternRule("site admin", r"://[^?#]*/wp-admin([/?#]|$)"),
    PatternRule("comment reply", r"[?&]replytocom=[0-9]"),
)


def _apart(code: object) -> bool:
    """Whether the node of a pattern always stands for something that ends a token: a mark, a class of marks, an end of the URL."""
    op, arg = code
    if op is regex.LITERAL:
        return not chr(arg).isalnum()
    if op is regex.IN:
        return all(o is regex.LITERAL and not chr(a).isalnum() for o, a in arg)
    if op is regex.AT:
        return arg in (regex.AT_BEGINNING, regex.AT_END, regex.AT_BEGINNING_STRING, regex.AT_END_STRING)
    if op is regex.SUBPATTERN:
        return len(arg[3]) == 1 and _apart(arg[3][0])
    return op is regex.BRANCH and all(len(x) == 1 and _apart(x[0]) for x in arg[1])


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The runs of a-z and 0-9 that every match holds as whole tokens."""
    nodes, out, run, open_ = list(regex.parse(pattern)), [], "", False
    for node in [*nodes, (None, None)]:
        if node[0] is regex.LITERAL and re.fullmatch("[a-z0-9]", chr(node[1])):
            run += chr(node[1])
            continue
        closed = node[0] is not None and _apart(node)
        if run and open_ and closed:
            out.append(run)
        run, open_ = "", closed or (node[0] in (regex.MAX_REPEAT, regex.MIN_REPEAT) and node[1][0] == 0 and not run and open_ and _optional_apart(node))
    return tuple(dict.fromkeys(out))


def _optional_apart(node: object) -> bool:
    """Whether an optional part, if it is there, ends in something that ends a token, so a token may follow in either case."""
    inner = list(node[1][2])
    while len(inner) == 1 and inner[0][0] is regex.SUBPATTERN:
        inner = list(inner[0][1][3])
    return bool(inner) and _apart(inner[-1])


def rules_from(table: DataFrame) -> list[PatternRule]:
    """Rules of a table (name, pattern)."""
    return [PatternRule(r["name"], r["pattern"]) for r in table.select("name", "pattern").distinct().orderBy("name", "pattern").collect()]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(lower_ascii(url), "[^a-z0-9]+"), ""))


def host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def index_rules(urls: DataFrame, rules: Sequence[PatternRule]) -> list[tuple[str, str, str]]:
    """(token, rule name, pattern): each rule under its rarest token; what is collected has a row per rule token at most."""
    tokens = {rule: literal_tokens(rule.pattern) for rule in rules}
    every = sorted({t for ts in tokens.values() for t in ts})
    counts = dict.fromkeys(every, 0)
    if every:
        known = F.broadcast(urls.sparkSession.createDataFrame(pa.table({"token": every})))  # of the rules' size
        seen = urls.select(F.explode("tokens").alias("token")).join(known, "token", "left_semi")
        counts.update({r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()})
    return [(min(ts, key=lambda t: (counts[t], t), default=""), rule.name, rule.pattern) for rule, ts in tokens.items()]


def matched_patterns(pages: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """url, pattern_rule: the first matching rule by name of each distinct URL that has one."""
    spark = pages.sparkSession
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    if not rules:
        return urls.where(F.lit(False)).select("url", F.lit(None).cast("string").alias("pattern_rule"))
    urls = materialize(urls.select("url", _tokens(F.col("url")).alias("tokens")), "urls")
    filed = index_rules(urls, rules)
    index = F.broadcast(spark.createDataFrame(pa.table({k: [x[i] for x in filed] for i, k in enumerate(("token", "name", "pattern"))})))
    every = F.array_append("tokens", F.lit("")) if any(not t for t, _, _ in filed) else F.col("tokens")
    fetched = urls.select("url", F.explode(every).alias("token")).join(index, "token")
    return fetched.where(F.expr(f"translate(url, '{UPPER}', '{LOWER}') RLIKE pattern")).groupBy("url").agg(F.min("name").alias("pattern_rule"))


def url_filters(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] | DataFrame = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule for each row; the host rule decides, else the patterns."""
    pages = pages.select("page_id", "url")
    rules = rules_from(pattern_rules) if isinstance(pattern_rules, DataFrame) else pattern_rules
    out = pages.where(F.col("url").isNotNull()).join(matched_patterns(pages, rules), "url", "left")
    # null URLs, however many, meet no rule and needn't meet in one task
    out = out.unionByName(pages.where(F.col("url").isNull()).withColumn("pattern_rule", F.lit(None).cast("string")))
    url = F.coalesce("url", F.lit(""))
    out = out.select("page_id", lower_ascii(F.regexp_extract(url, SPLIT_URL, 1)).alias("host"), F.regexp_extract(url, SPLIT_URL, 2).alias("path"), "pattern_rule")
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    other = F.when(F.col("pattern_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "pattern_rule")


def url_filters_sql(host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES) -> str:
    longest = sorted(host_rules, key=lambda r: -len(r.host) - len(r.path))
    when = [(f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')", r) for r in longest]
    names = " ".join(f"WHEN {c} THEN '{r.host}{r.path}'" for c, r in when)
    verdicts = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in when)
    patterns = " ".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.name}'" for r in sorted(pattern_rules))
    low = f"translate(url, '{UPPER}', '{LOWER}')"
    return (
        f"WITH u AS (SELECT page_id, {low} AS low, translate(regexp_extract(coalesce(url, ''), '{SPLIT_URL}', 1), '{UPPER}', '{LOWER}') AS host, "
        f"regexp_extract(coalesce(url, ''), '{SPLIT_URL}', 2) AS path FROM pages), "
        f"v AS (SELECT page_id, host, path, CASE {names} END AS rule, CASE {verdicts} END AS by_host, CASE {patterns} END AS pattern_rule FROM u) "
        "SELECT page_id, host, path, rule, coalesce(by_host, CASE WHEN pattern_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern_rule FROM v"
    )
