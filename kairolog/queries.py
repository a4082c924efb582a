"""The driver queries for the engine's own operators, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.session import Database, TxCount

Query = Callable[[SparkSession, str], DataFrame]

TABLES = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {}),
}


def database(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> Database:
    db = Database(spark, facts=facts)
    for name, (key, refs) in TABLES.items():
        db.register(name, partial(spark.read.parquet, f"{sf_dir}/{name}.parquet"), key, refs)
    return db


WEEK = 7 * 86_400_000


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from events: who did what, each true for a week; a third of the rows are retractions."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    v = F.struct(F.lit(0).cast("tinyint").alias("t"), F.col("event_type").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("boolean").alias("b"))
    return ev.select(F.col("user_id").cast("string").alias("e"), F.lit(":user/act").alias("a"), v.alias("v"), ms.alias("tx_id"), (F.col("event_id") + 1).alias("tx_count"), ms.alias("valid_from"), (ms + WEEK).alias("valid_to"), (F.col("event_id") % 3 != 0).alias("asserted"))


FOREVER = (1 << 63) - 1
RETRACTED = 1_000_000_000  # counters of the retractions begin here


def fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of several attributes and types: events (who, what, how much, flagged), and users in a tree.

    Values are integers for even events and floats for odd ones; every second event's facts hold for a week only; the
    type of every seventh event is retracted."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    none = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}

    def v(tag: int, **given: str) -> Column:
        return F.struct(F.lit(tag).cast("tinyint").alias("t"), *(F.expr(given.get(k, f"CAST(NULL AS {kind})")).alias(k) for k, kind in none.items()))

    fact = lambda a, value, when=True: F.when(F.lit(when) if when is True else F.expr(when), F.struct(F.lit(a).alias("a"), value.alias("v"), F.lit(True).alias("asserted"), F.lit(0).cast("bigint").alias("later")))
    gone = F.when(F.expr("event_id % 7 = 0"), F.struct(F.lit(":event/type").alias("a"), v(5, s="concat(':', event_type)").alias("v"), F.lit(False).alias("asserted"), F.lit(RETRACTED).cast("bigint").alias("later")))
    facts = F.array(
        fact(":event/by", v(4, s="concat('u', user_id)")), fact(":event/type", v(5, s="concat(':', event_type)")), fact(":event/value", v(1, i="CAST(value AS BIGINT)"), "event_id % 2 = 0"),
        fact(":event/value", v(2, f="value"), "event_id % 2 = 1"), fact(":event/flag", v(3, b="event_id % 5 = 0")), gone,
    )
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    out = ev.withColumn("ms", ms).select(F.expr("concat('x', event_id)").alias("e"), "ms", "event_id", F.explode(facts).alias("f")).where("f IS NOT NULL")
    tx = F.col("event_id") + 1 + F.col("f.later")
    out = out.select("e", "f.a", "f.v", F.col("ms").alias("tx_id"), tx.alias("tx_count"), F.col("ms").alias("valid_from"), F.expr(f"IF(event_id % 2 = 0, {FOREVER}, ms + {WEEK})").alias("valid_to"), "f.asserted")
    tree = F.array(F.struct(F.lit(":user/name").alias("a"), v(0, s="concat('user ', user_id)").alias("v")), F.struct(F.lit(":user/up").alias("a"), v(4, s="concat('u', user_id div 2)").alias("v")))
    users = ev.select("user_id").distinct().select(F.expr("concat('u', user_id)").alias("e"), F.explode(tree).alias("f"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return out.unionByName(users.select("e", "f.a", "f.v", zero.alias("tx_id"), one.alias("tx_count"), zero.alias("valid_from"), F.lit(FOREVER).cast("bigint").alias("valid_to"), F.lit(True).alias("asserted")))


#: name: (query, result columns, SQL)
PLAIN: dict[str, tuple[str, list[str], str]] = {
    "flagship_segments": (
        "[:find ?seg (count ?o) (sum ?t) :where [?o :orders/o_custkey ?c] [?o :orders/o_totalprice ?t] [?c :customer/c_mktsegment ?seg] [(> ?t 100000.0)]]",
        ["segment", "n", "total"],
        "SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "scan_filter": ("[:find ?o ?t :where [?o :orders/o_totalprice ?t] [?o :orders/o_orderstatus \"F\"] [(> ?t 200000)]]", ["o", "t"], "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000"),
    "scan_entity": ("[:find ?n ?b :where [7 :customer/c_name ?n] [7 :customer/c_acctbal ?b]]", ["n", "b"], "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7"),
    "scan_wildcard": ("[:find ?p :where [?p :part/p_size _] [_ :region/r_name \"ASIA\"]]", ["p"], "SELECT p_partkey AS p FROM part, region WHERE r_name = 'ASIA' AND p_size IS NOT NULL"),
    "bag_projection": ("[:find ?s :where [?o :orders/o_orderstatus ?s]]", ["s"], "SELECT o_orderstatus AS s FROM orders"),
    "expr_arith": ("[:find ?o ?x :where [?o :orders/o_totalprice ?t] [(- (* ?t 2) 1.5) ?x]]", ["o", "x"], "SELECT o_orderkey AS o, o_totalprice * 2 - 1.5 AS x FROM orders"),
    "expr_div_int": ("[:find ?p ?h :where [?p :part/p_size ?z] [(/ ?z (- ?z 7)) ?h]]", ["p", "h"], "SELECT p_partkey AS p, CAST(p_size // (p_size - 7) AS BIGINT) AS h FROM part WHERE p_size > 7 UNION ALL SELECT p_partkey, CAST(-(p_size // (7 - p_size)) AS BIGINT) FROM part WHERE p_size < 7"),
    "expr_wrap": ("[:find ?p ?w :where [?p :part/p_size ?z] [(+ ?z 9223372036854775807) ?w]]", ["p", "w"], "SELECT p_partkey AS p, CAST(CAST(p_size AS HUGEINT) + 9223372036854775807 - (CASE WHEN p_size > 0 THEN 18446744073709551616 ELSE 0 END)::HUGEINT AS BIGINT) AS w FROM part"),
    "expr_string_preds": ("[:find ?p :where [?p :part/p_type ?t] [?p :part/p_name ?n] [(contains? ?n \"a\")] [(starts-with? ?t \"S\")] [(ends-with? ?n \"1\")]]", ["p"], "SELECT p_partkey AS p FROM part WHERE contains(p_name, 'a') AND starts_with(p_type, 'S') AND ends_with(p_name, '1')"),
    "expr_regex": ("[:find ?c :where [?c :customer/c_name ?n] [(matches? ?n \"[0-9]*7$\")]]", ["c"], "SELECT c_custkey AS c FROM customer WHERE regexp_matches(c_name, '[0-9]*7$')"),
    "expr_bind_nested": ("[:find ?l ?rev :where [?l :supplier/s_acctbal ?b] [?l :supplier/s_nationkey ?n] [(+ (* ?b 2) (- ?b 1)) ?rev] [(>= ?rev 0)]]", ["l", "rev"], "SELECT s_suppkey AS l, s_acctbal * 2 + (s_acctbal - 1) AS rev FROM supplier WHERE s_acctbal * 2 + (s_acctbal - 1) >= 0"),
    "expr_equality": ("[:find ?p :where [?p :part/p_size ?z] [?p :part/p_brand ?b] [(!= ?b \"Brand#1\")] [(= ?z 5)]]", ["p"], "SELECT p_partkey AS p FROM part WHERE p_brand <> 'Brand#1' AND p_size = 5"),
    "type_preds": ("[:find ?p :where [?p :part/p_size ?z] [?p :part/p_name ?n] [?p :part/p_retailprice ?r] [(integer? ?z)] [(string? ?n)] [(float? ?r)]]", ["p"], "SELECT p_partkey AS p FROM part"),
    "join_2": ("[:find ?o ?n :where [?o :orders/o_custkey ?c] [?c :customer/c_name ?n]]", ["o", "n"], "SELECT o_orderkey AS o, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_4_chain": (
        "[:find ?rn (count ?o) :where [?o :orders/o_custkey ?c] [?c :customer/c_nationkey ?n] [?n :nation/n_regionkey ?r] [?r :region/r_name ?rn]]",
        ["region", "n"],
        "SELECT r_name AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "join_lineitem": (
        "[:find ?st (sum ?q) (count ?l) :where [?l :lineitem/l_orderkey ?o] [?l :lineitem/l_quantity ?q] [?o :orders/o_orderstatus ?st]]",
        ["status", "quantity", "n"],
        "SELECT o_orderstatus AS status, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    "self_join": ("[:find ?a ?b :where [?a :supplier/s_nationkey ?n] [?b :supplier/s_nationkey ?n] [?a :supplier/s_acctbal ?x] [?b :supplier/s_acctbal ?y] [(< ?x ?y)]]", ["a", "b"], "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_acctbal < b.s_acctbal"),
    "theta_join": ("[:find ?n ?s :where [?n :nation/n_name ?nn] [?s :supplier/s_acctbal ?b] [?n :nation/n_regionkey 1] [(>= ?b 9000)]]", ["n", "s"], "SELECT n_nationkey AS n, s_suppkey AS s FROM nation, supplier WHERE n_regionkey = 1 AND s_acctbal >= 9000"),
    "cross_join_small": ("[:find ?a ?b :where [?x :region/r_name ?a] [?y :region/r_name ?b]]", ["a", "b"], "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "not_anti": ("[:find ?o :where [?o :orders/o_orderstatus _] (not-join [?o] [?l :lineitem/l_orderkey ?o])]", ["o"], "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "not_join_exist": ("[:find ?c :where [?c :customer/c_name ?n] (not-join [?c] [?o :orders/o_custkey ?c] [?o :orders/o_orderpriority \"1-URGENT\"])]", ["c"], "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "not_expr": ("[:find ?p :where [?p :part/p_size ?z] (not [(> ?z 10)])]", ["p"], "SELECT p_partkey AS p FROM part WHERE NOT p_size > 10"),
    "not_pattern_expr": ("[:find ?s :where [?s :supplier/s_acctbal ?b] [?s :supplier/s_nationkey ?n] (not-join [?b ?n] [?c :customer/c_nationkey ?n] [?c :customer/c_acctbal ?x] [(> ?x ?b)])]", ["s"], "SELECT s_suppkey AS s FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal)"),
    "or_union": ("[:find ?o :where [?o :orders/o_totalprice ?t] (or [?o :orders/o_orderstatus \"F\"] [?o :orders/o_orderpriority \"1-URGENT\"])]", ["o"], "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"),
    "or_new_var": ("[:find ?n ?x :where [?c :customer/c_nationkey ?n] (or [?c :customer/c_mktsegment ?x] [?c :customer/c_name ?x])]", ["n", "x"], "SELECT c_nationkey::BIGINT AS n, x FROM (SELECT c_custkey, c_nationkey, c_mktsegment AS x FROM customer UNION SELECT c_custkey, c_nationkey, c_name FROM customer)"),
    "or_join_semi": ("[:find ?c :where [?c :customer/c_name _] (or-join [?c] (and [?o :orders/o_custkey ?c] [?o :orders/o_orderpriority \"1-URGENT\"]) [?c :customer/c_mktsegment \"BUILDING\"])]", ["c"], "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "or_with_not": ("[:find ?o :where [?o :orders/o_custkey ?c] [?o :orders/o_totalprice ?t] (or [?o :orders/o_orderstatus \"O\"] (and [?o :orders/o_totalprice ?t] (not [?c :customer/c_mktsegment \"BUILDING\"])))]", ["o"], "SELECT o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' OR c_mktsegment <> 'BUILDING'"),
    "agg_count": ("[:find (count ?o) :where [?o :orders/o_orderstatus \"F\"]]", ["n"], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "agg_count_distinct": ("[:find (count-distinct ?c) :where [?o :orders/o_custkey ?c]]", ["n"], "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "agg_sum": ("[:find (sum ?z) :where [?p :part/p_size ?z]]", ["s"], "SELECT sum(p_size)::BIGINT AS s FROM part"),
    "agg_sum_distinct": ("[:find ?b (sum-distinct ?z) :where [?p :part/p_size ?z] [?p :part/p_brand ?b]]", ["b", "s"], "SELECT p_brand AS b, sum(DISTINCT p_size)::BIGINT AS s FROM part GROUP BY 1"),
    "agg_min_max": ("[:find ?b (min ?z) (max ?z) (min ?n) :where [?p :part/p_size ?z] [?p :part/p_brand ?b] [?p :part/p_name ?n]]", ["b", "lo", "hi", "first"], "SELECT p_brand AS b, min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi, min(p_name) AS first FROM part GROUP BY 1"),
    "agg_grouped": ("[:find ?f ?s (count ?l) (sum ?q) :where [?l :lineitem/l_returnflag ?f] [?l :lineitem/l_linestatus ?s] [?l :lineitem/l_quantity ?q]]", ["f", "s", "n", "q"], "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"),
    "agg_with": ("[:find ?s (count ?o) :with ?pr :where [?o :orders/o_orderstatus ?s] [?o :orders/o_orderpriority ?pr]]", ["s", "n"], "SELECT s, n FROM (SELECT o_orderstatus AS s, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)"),
    "agg_empty_count": ("[:find (count ?o) :where [?o :orders/o_orderstatus \"none\"]]", ["n"], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'none'"),
    "agg_empty_sum": ("[:find (sum ?t) :where [?o :orders/o_orderstatus \"none\"] [?o :orders/o_totalprice ?t]]", ["s"], "SELECT sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'none' HAVING count(*) > 0"),
    "win_row_number": ("[:find ?o (row-number :over (:partition-by ?c :order-by ?o)) :where [?o :orders/o_custkey ?c]]", ["o", "n"], "SELECT o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"),
    "win_rank": ("[:find ?p (rank :over (:partition-by ?b :order-by ?z :desc)) :where [?p :part/p_brand ?b] [?p :part/p_size ?z]]", ["p", "r"], "SELECT p_partkey AS p, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part"),
    "win_running_sum": ("[:find ?p (sum ?z :over (:partition-by ?b :order-by ?p)) :where [?p :part/p_brand ?b] [?p :part/p_size ?z]]", ["p", "s"], "SELECT p_partkey AS p, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM part"),
    "win_running_count": ("[:find ?e (count ?u :over (:partition-by ?u :order-by ?e)) :where [?e :events/user_id ?u]]", ["e", "n"], "SELECT event_id AS e, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events"),
    "win_running_min_max": ("[:find ?e (min ?v :over (:partition-by ?u :order-by ?e)) (max ?v :over (:partition-by ?u :order-by ?e)) :where [?e :events/user_id ?u] [?e :events/value ?v]]", ["e", "lo", "hi"], "SELECT event_id AS e, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"),
    "win_running_avg": ("[:find ?p (avg ?z :over (:partition-by ?b :order-by ?p)) :where [?p :part/p_brand ?b] [?p :part/p_size ?z]]", ["p", "m"], "SELECT p_partkey AS p, avg(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS m FROM part"),
    "entity_kinds": ("[:find (count ?x) :where [?x :customer/c_name ?n] [?x :orders/o_totalprice ?t]]", ["n"], "SELECT 0::BIGINT AS n"),
    "entity_kinds_number": ("[:find (count ?p) :where [?p :part/p_name ?n] [?s :part/p_size ?p]]", ["n"], "SELECT 0::BIGINT AS n"),
    "attribute_var": ("[:find ?a (count ?v) :where [?n :nation/n_regionkey 1] [?n ?a ?v]]", ["a", "n"], "SELECT unnest([':nation/n_nationkey', ':nation/n_name', ':nation/n_regionkey']) AS a, count(*) AS n FROM nation WHERE n_regionkey = 1"),
    "or_filter_expr": ("[:find ?p ?z :where [?p :part/p_size ?z] [?p :part/p_brand ?b] (or [?p :part/p_brand \"Brand#1\"] [(> ?z 45)] (and [?p :part/p_type _] [(< ?z 3)]))]", ["p", "z"], "SELECT p_partkey AS p, p_size::BIGINT AS z FROM part WHERE p_brand = 'Brand#1' OR p_size > 45 OR p_size < 3"),
    "win_global": ("[:find ?p (row-number :over (:order-by ?p)) (sum ?z :over (:order-by ?p)) (avg ?z :over (:order-by ?p)) (max ?r :over (:order-by ?p :desc)) :where [?p :part/p_size ?z] [?p :part/p_retailprice ?r]]", ["p", "n", "s", "m", "hi"], "SELECT p_partkey AS p, row_number() OVER w AS n, sum(p_size) OVER w::BIGINT AS s, avg(p_size) OVER w AS m, max(p_retailprice) OVER (ORDER BY p_partkey DESC ROWS UNBOUNDED PRECEDING) AS hi FROM part WINDOW w AS (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)"),
    "win_global_rank": ("[:find ?o (rank :over (:order-by ?d :desc)) :where [?o :orders/o_orderdate ?d]]", ["o", "r"], "SELECT o_orderkey AS o, rank() OVER (ORDER BY o_orderdate DESC) AS r FROM orders"),
    "mixed_agg_window": ("[:find ?s (count ?o) (row-number :over (:order-by ?s)) :where [?o :orders/o_orderstatus ?s]]", ["s", "n", "r"], "SELECT s, n, row_number() OVER (ORDER BY s) AS r FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)"),
}
_LOG = f"""WITH log AS (SELECT user_id::VARCHAR AS e, event_type AS v, epoch_us(ts) // 1000 AS tx_id, event_id + 1 AS tx_count, epoch_us(ts) // 1000 AS vf, epoch_us(ts) // 1000 + {WEEK} AS vt, event_id % 3 <> 0 AS asserted FROM events),
cut AS (SELECT * FROM log WHERE {{cut}}), g AS (SELECT *, max(tx_count) FILTER (WHERE NOT asserted) OVER (PARTITION BY e, v) AS r FROM cut),
k AS (SELECT *, row_number() OVER (PARTITION BY e, v, vf, vt ORDER BY tx_count DESC) AS n FROM g WHERE asserted AND (r IS NULL OR tx_count > r)), net AS (SELECT * FROM k WHERE n = 1) """
#: name: (query, result columns, transaction filter, SQL over net)
TEMPORAL: dict[str, tuple[str, list[str], str, str]] = {
    "net_asserted": ("[:find ?e ?v :any-valid-time :where [?e :user/act ?v]]", ["e", "v"], "true", "SELECT e, v FROM net"),
    "asof_counter": ("[:find ?e ?v :as-of 500 :any-valid-time :where [?e :user/act ?v]]", ["e", "v"], "tx_count <= 500", "SELECT e, v FROM net"),
    "asof_ts": ("[:find ?v (count ?e) :as-of \"2024-01-20\" :any-valid-time :where [?e :user/act ?v]]", ["v", "n"], "tx_id <= epoch_ms(TIMESTAMP '2024-01-20')", "SELECT v, count(*) AS n FROM net GROUP BY 1"),
    "valid_at": ("[:find ?e ?v :valid-at \"2024-01-15\" :where [?e :user/act ?v]]", ["e", "v"], "true", "SELECT e, v FROM net WHERE vf <= epoch_ms(TIMESTAMP '2024-01-15') AND vt > epoch_ms(TIMESTAMP '2024-01-15')"),
    "any_valid_time": ("[:find ?v (count ?e) :valid-at :any-valid-time :where [?e :user/act ?v]]", ["v", "n"], "true", "SELECT v, count(*) AS n FROM net GROUP BY 1"),
    "pseudo_attrs": ("[:find ?e ?v ?f ?t ?c ?i :any-valid-time :where [?e :user/act ?v] [?e :db/valid-from ?f] [?e :db/valid-to ?t] [?e :db/tx-count ?c] [?e :db/tx-id ?i]]", ["e", "v", "f", "t", "c", "i"], "true", "SELECT e, v, vf AS f, vt AS t, tx_count AS c, tx_id AS i FROM net"),
    "interval_overlap": ("[:find ?e ?c :any-valid-time :where [?e :user/act ?v] [?e :db/valid-from ?f] [?e :db/valid-to ?t] [?e :db/tx-count ?c] [(< ?f 1706000000000)] [(> ?t 1705000000000)]]", ["e", "c"], "true", "SELECT e, tx_count AS c FROM net WHERE vf < 1706000000000 AND vt > 1705000000000"),
    "prepared_asof": ("[:find ?e ?v :as-of $n :any-valid-time :where [?e :user/act ?v]]", ["e", "v"], "tx_count <= 700", "SELECT e, v FROM net"),
}

_FACTS = f"""WITH ev AS (SELECT 'x' || event_id AS x, 'u' || user_id AS u, ':' || event_type AS t, CASE WHEN event_id % 2 = 0 THEN trunc(value) ELSE value END AS v,
event_id % 5 = 0 AS flag, event_id, event_id % 7 <> 0 AS typed, epoch_us(ts) // 1000 AS ms FROM events), now AS (SELECT * FROM ev WHERE event_id % 2 = 0 OR ms + {WEEK} > epoch_ms(current_timestamp::TIMESTAMP)),
us AS (SELECT DISTINCT 'u' || user_id AS u, 'u' || user_id // 2 AS up, 'user ' || user_id AS name, user_id AS id FROM events) """
#: name: (rules, query, result columns, SQL) over the fact log
LOGGED: dict[str, tuple[str, str, list[str], str]] = {
    "log_point_attribute": ("", "[:find ?x :where [?x :event/flag true]]", ["x"], "SELECT x FROM now WHERE flag"),
    "log_join_two": ("", "[:find ?x ?u ?v :where [?x :event/by ?u] [?x :event/value ?v] [(> ?v 90)]]", ["x", "u", "v"], "SELECT x, u, v FROM now WHERE v > 90"),
    "log_join_star": ("", "[:find ?n ?t (count ?x) :where [?x :event/by ?u] [?x :event/type ?t] [?x :event/flag true] [?u :user/name ?n]]", ["u", "t", "n"], "SELECT name AS u, t, count(*) AS n FROM now JOIN us USING (u) WHERE flag AND typed GROUP BY 1, 2"),
    "log_join_refs": ("", "[:find ?a ?b :where [?u :user/name ?a] [?u :user/up ?w] [?w :user/up ?z] [?z :user/name ?b]]", ["a", "b"], "SELECT a.name AS a, c.name AS b FROM us a JOIN us b ON b.u = a.up JOIN us c ON c.u = b.up"),
    "log_same_var": ("", "[:find ?u :where [?u :user/up ?u]]", ["u"], "SELECT u FROM us WHERE u = up"),
    "log_not": ("", "[:find ?x ?u :where [?x :event/by ?u] (not [?x :event/type :click])]", ["x", "u"], "SELECT x, u FROM now WHERE NOT (t = ':click' AND typed)"),
    "log_not_join": ("", "[:find ?u :where [?u :user/name _] (not-join [?u] [?x :event/by ?u] [?x :event/flag true])]", ["u"], "SELECT u FROM us WHERE u NOT IN (SELECT u FROM now WHERE flag)"),
    "log_or": ("", "[:find ?x :where [?x :event/by ?u] (or [?x :event/flag true] [?x :event/type :purchase])]", ["x"], "SELECT x FROM now WHERE flag OR (t = ':purchase' AND typed)"),
    "log_or_nested": ("", "[:find ?x :where [?x :event/value ?v] (or (and [?x :event/flag true] (or [?x :event/type :click] [?x :event/type :view])) [(> ?v 95)])]", ["x"], "SELECT x FROM now WHERE (flag AND typed AND t IN (':click', ':view')) OR v > 95"),
    "log_or_join": ("", "[:find ?n :where [?u :user/name ?n] (or-join [?u] (and [?x :event/by ?u] [?x :event/value ?v] [(> ?v 99)]) [?u :user/up ?u])]", ["n"], "SELECT name AS n FROM us WHERE u = up OR u IN (SELECT u FROM now WHERE v > 99)"),
    "log_aggregate": ("", "[:find ?t (count ?x) (sum ?v) (count-distinct ?u) :where [?x :event/type ?t] [?x :event/value ?v] [?x :event/by ?u]]", ["t", "n", "s", "u"], "SELECT t, count(*) AS n, sum(v) AS s, count(DISTINCT u) AS u FROM now WHERE typed GROUP BY 1"),
    "log_type_preds": ("", "[:find (count ?x) :any-valid-time :where [?x :event/value ?v] [(integer? ?v)]]", ["n"], "SELECT count(*) AS n FROM ev WHERE event_id % 2 = 0"),
    "log_attribute_var": ("", "[:find ?a (count ?v) :where [?x :event/flag true] [?x ?a ?v]]", ["a", "n"], "SELECT a, count(*) AS n FROM (SELECT unnest([':event/by', ':event/value', ':event/flag'] || CASE WHEN typed THEN [':event/type'] ELSE [] END) AS a FROM now WHERE flag) GROUP BY 1"),
    "log_window_mixed": ("", "[:find ?x (rank :over (:partition-by ?u :order-by ?v)) :any-valid-time :where [?x :event/by ?u] [?x :event/value ?v] [(> ?v 20)]]", ["x", "n"], "SELECT x, rank() OVER (PARTITION BY u ORDER BY v) AS n FROM ev WHERE v > 20"),
    "log_valid_at": ("", "[:find ?t (count ?x) :valid-at \"2024-01-15\" :where [?x :event/type ?t] [?x :db/valid-at ?m]]", ["t", "n"], f"SELECT t, count(*) AS n FROM ev WHERE typed AND ms <= epoch_ms(TIMESTAMP '2024-01-15') AND (event_id % 2 = 0 OR ms + {WEEK} > epoch_ms(TIMESTAMP '2024-01-15')) GROUP BY 1"),
    "log_moment": ("", "[:find ?u ?m :valid-at \"2024-01-15\" :where [?u :user/up ?u] [?u :db/valid-at ?m]]", ["u", "m"], "SELECT u, epoch_ms(TIMESTAMP '2024-01-15')::DOUBLE AS m FROM us WHERE u = up"),
    "log_as_of": ("", f"[:find ?t (count ?x) :as-of {RETRACTED} :any-valid-time :where [?x :event/type ?t] [?x :event/by ?u]]", ["t", "n"], "SELECT t, count(*) AS n FROM ev GROUP BY 1"),
    "log_rule_reach": ("(rule [(above ?x ?y) [?x :user/up ?y]]) (rule [(above ?x ?y) [?x :user/up ?z] (above ?z ?y)])", "[:find ?x ?y :where (above ?x ?y)]", ["x", "y"], ", t(a, b) AS (SELECT u, up FROM us UNION SELECT t.a, us.up FROM t JOIN us ON t.b = us.u) SELECT a AS x, b AS y FROM t"),
    "log_rule_not": ("(rule [(quiet ?u) [?u :user/name ?n] (not-join [?u] [?x :event/by ?u] [?x :event/type :purchase])])", "[:find ?n :where (quiet ?u) [?u :user/name ?n]]", ["n"], "SELECT name AS n FROM us WHERE u NOT IN (SELECT u FROM now WHERE typed AND t = ':purchase')"),
}
_TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey // 2 > 0), t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) "
_UP = "(rule [(up ?x ?y) [?x :tree/parent ?y]]) (rule [(up ?x ?y) [?x :tree/parent ?z] (up ?z ?y)])"
#: name: (rules, query, result columns, SQL)
RULES: dict[str, tuple[str, str, list[str], str]] = {
    "rule_nonrec": ("(rule [(big ?p) [?p :part/p_size ?z] [(> ?z 40)]])", "[:find ?p ?n :where (big ?p) [?p :part/p_name ?n]]", ["p", "n"], "SELECT p_partkey AS p, p_name AS n FROM part WHERE p_size > 40"),
    "rule_multi_head": ("(rule [(odd ?p) [?p :part/p_size 1]]) (rule [(odd ?p) [?p :part/p_brand \"Brand#1\"]])", "[:find ?p :where (odd ?p)]", ["p"], "SELECT p_partkey AS p FROM part WHERE p_size = 1 OR p_brand = 'Brand#1'"),
    "rule_recursive_tc": (_UP, "[:find ?x ?y :where (up ?x ?y)]", ["x", "y"], _TREE + "SELECT a AS x, b AS y FROM t"),
    "rule_magic_bound": (_UP, "[:find ?y :where (up 150 ?y)]", ["y"], _TREE + "SELECT b AS y FROM t WHERE a = 150"),
    "rule_bound_second": (_UP, "[:find ?x :where (up ?x 7)]", ["x"], _TREE + "SELECT a AS x FROM t WHERE b = 7"),
    "rule_mutual": ("(rule [(even ?x) [?x :tree/parent 1]]) (rule [(odd ?x) [?x :tree/parent ?y] (even ?y)]) (rule [(even ?x) [?x :tree/parent ?y] (odd ?y)])", "[:find ?x :where (odd ?x)]", ["x"], "WITH RECURSIVE d(x, n) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey // 2 = 1 UNION SELECT p_partkey, n + 1 FROM part JOIN d ON p_partkey // 2 = x) SELECT DISTINCT x FROM d WHERE n % 2 = 1"),
    "rule_nonlinear": ("(rule [(to ?x ?y) [?x :tree/parent ?y]]) (rule [(to ?x ?y) (to ?x ?z) (to ?z ?y)])", "[:find ?x ?y :where (to ?x ?y)]", ["x", "y"], _TREE + "SELECT a AS x, b AS y FROM t"),
    "rule_nonlinear_bound": ("(rule [(to ?x ?y) [?x :tree/parent ?y]]) (rule [(to ?x ?y) (to ?x ?z) (to ?z ?y)])", "[:find ?y :where (to 150 ?y)]", ["y"], _TREE + "SELECT b AS y FROM t WHERE a = 150"),
    "rule_mutual_bound": ("(rule [(once ?x ?y) [?x :tree/parent ?y]]) (rule [(twice ?x ?y) [?x :tree/parent ?z] (once ?z ?y)]) (rule [(once ?x ?y) [?x :tree/parent ?z] (twice ?z ?y)])", "[:find ?y :where (twice 150 ?y)]", ["y"], "SELECT unnest([37, 9, 2])::BIGINT AS y"),
    "rule_two_constants": (_UP, "[:find ?y ?z :where (up 150 ?y) (up 99 ?z)]", ["y", "z"], _TREE + "SELECT p.b AS y, q.b AS z FROM t p, t q WHERE p.a = 150 AND q.a = 99"),
    "rule_stratified_not": (_UP + "(rule [(apart ?x) [?x :tree/parent ?y] (not (up ?x 3))])", "[:find ?x :where (apart ?x)]", ["x"], _TREE + "SELECT DISTINCT a AS x FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = e.a AND t.b = 3)"),
    "rule_or_body": ("(rule [(near ?x ?y) (or [?x :tree/parent ?y] [?y :tree/parent ?x])])", "[:find ?x ?y :where (near ?x ?y)]", ["x", "y"], "WITH e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey // 2 > 0) SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e"),
}


def _plain(text: str, columns: list[str]) -> Query:
    return lambda spark, sf_dir: database(spark, sf_dir).execute(f"(query {text})").to_df(columns)


def _temporal(text: str, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, facts=event_log(spark, sf_dir))
        found = db.prepare(f"(query {text})").execute({"n": TxCount(700)}) if "$" in text else db.execute(f"(query {text})")
        return found.df.select(*(F.col(f"`{c}`.s").alias(n) if k == "any" else F.col(f"`{c}`").alias(n) for c, n, k in zip(found.df.columns, columns, found.kinds, strict=True)))

    return run


def _logged(rules: str, text: str, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, facts=fact_log(spark, sf_dir))
        db.execute_script(rules)
        found = db.execute(f"(query {text})")
        shown = lambda c: F.coalesce(c["i"].cast("double"), c["f"])
        numbers = {"v", "s", "m"}  # the columns that hold tagged numbers
        return found.df.select(*((shown(F.col(f"`{c}`")) if n in numbers else F.col(f"`{c}`.s")).alias(n) if k == "any" else (F.col(f"`{c}`").cast("double") if n in numbers else F.col(f"`{c}`")).alias(n) for c, n, k in zip(found.df.columns, columns, found.kinds, strict=True)))

    return run


def _rules(rules: str, text: str, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        tree = part.select("p_partkey", F.expr("nullif(p_partkey div 2, 0L)").alias("parent"))
        db.register("tree", tree, "p_partkey", {"parent": "tree"})
        db.execute_script(rules)
        return db.execute(f"(query {text})").to_df(columns)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_segments"](spark, sf_dir)


def udaf_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.register_aggregate("geomean", lambda: 0.0, lambda s, x: s + math.log(x), lambda s, n: round(math.exp(s / n), 4))
    return db.execute("(query [:find ?b (geomean ?r) (count ?p) :where [?p :part/p_brand ?b] [?p :part/p_retailprice ?r]])").to_df(["b", "g", "n"])


def udaf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.register_aggregate("widest", lambda: 0, lambda s, x: max(s, len(x)), lambda s, n: s, returns="int")
    return db.execute("(query [:find ?n (widest ?m :over (:partition-by ?r :order-by ?n)) :where [?n :nation/n_regionkey ?r] [?n :nation/n_name ?m]])").to_df(["n", "w"])


def udf_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.register_predicate("prime?", lambda x: x > 1 and all(x % d for d in range(2, math.isqrt(x) + 1)))
    return db.execute("(query [:find ?p :where [?p :part/p_size ?z] [(prime? ?z)]])").to_df(["p"])


def prepared_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = database(spark, sf_dir).prepare("(query [:find ?o ?t :where [?o :orders/o_orderstatus $st] [?o :orders/o_totalprice ?t] [(< ?t $max)]])")
    return statement.execute({"st": "O", "max": 50000.0}).to_df(["o", "t"])


def queries() -> dict[str, Query]:
    out = {k: _plain(text, columns) for k, (text, columns, _) in PLAIN.items()}
    out |= {k: _temporal(text, columns) for k, (text, columns, _, _) in TEMPORAL.items()}
    out |= {k: _logged(rules, text, columns) for k, (rules, text, columns, _) in LOGGED.items()}
    out |= {k: _rules(rules, text, columns) for k, (rules, text, columns, _) in RULES.items()}
    return out | {f.__name__: f for f in (udaf_geomean, udaf_window, udf_predicate, prepared_value)}


def oracle_sql() -> dict[str, str]:
    out = {k: sql for k, (*_, sql) in PLAIN.items()} | {k: sql for k, (*_, sql) in RULES.items()}
    out |= {k: _LOG.format(cut=cut) + sql for k, (_, _, cut, sql) in TEMPORAL.items()}
    out |= {k: (_FACTS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() if sql.startswith(",") else _FACTS) + sql for k, (*_, sql) in LOGGED.items()}
    primes = ", ".join(str(p) for p in range(2, 100) if all(p % d for d in range(2, math.isqrt(p) + 1)))
    return out | {
        "udaf_geomean": "SELECT p_brand AS b, round(exp(sum(ln(p_retailprice)) / count(*)), 4) AS g, count(*) AS n FROM part GROUP BY 1",
        "udaf_window": "SELECT n_nationkey::BIGINT AS n, max(length(n_name)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS w FROM nation",
        "udf_predicate": f"SELECT p_partkey AS p FROM part WHERE p_size IN ({primes})",
        "prepared_value": "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000",
    }
