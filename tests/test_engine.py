import math
import uuid

import pytest

from kairolog.functions.values import entity_id
from kairolog.operators.rules import LimitError
from kairolog.plans.edn import Keyword, ParseError
from kairolog.session import ANY_VALID_TIME, Database, Entity, TxCount

PEOPLE = '(transact [[:alice :name "Alice"] [:alice :age 30] [:bob :name "Bob"] [:bob :age 25] [:alice :friend :bob] [:bob :friend :carol] [:carol :name "Carol"] [:carol :y 1.5] [:bob :y 2] [:carol :x nil]])'


def rows(db, text):
    return sorted(db.execute(text).rows(), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    db = Database(spark)
    db.execute(PEOPLE)
    for r in ("(rule [(reach ?x ?y) [?x :friend ?y]])", "(rule [(reach ?x ?y) [?x :friend ?z] (reach ?z ?y)])"):
        db.execute(r)
    return db


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("[:find ?n :where [?e :name ?n] [?e :age ?a] [(> ?a 26)]]", [("Alice",)]),
        ("[:find ?n ?m :where [?e :friend ?f] [?e :name ?n] [?f :name ?m]]", [("Alice", "Bob"), ("Bob", "Carol")]),
        ("[:find ?n :where [?e :name ?n] (not [?e :y 2])]", [("Alice",), ("Carol",)]),
        ("[:find ?n :where [?e :name ?n] (not-join [?e] [?e :friend ?f] [?f :age ?g])]", [("Bob",), ("Carol",)]),
        ("[:find ?n :where [?e :name ?n] (or [?e :age 25] [?e :y 1.5])]", [("Bob",), ("Carol",)]),
        ('[:find ?n :where [?e :name ?n] (or-join [?e] (and [?e :friend ?f] [?f :name "Bob"]) [?e :y 1.5])]', [("Alice",), ("Carol",)]),
        ("[:find ?n ?d :where [?e :name ?n] [?e :y ?y] [(* ?y 2) ?d]]", [("Bob", 4), ("Carol", 3.0)]),
        ("[:find (sum ?y) (count ?e) :where [?e :y ?y]]", [(3.5, 2)]),
        ("[:find (count ?e) :where [?e :none ?x]]", [(0,)]),
        ("[:find (sum ?x) :where [?e :none ?x]]", []),
        ("[:find ?e :where [?e :x nil]]", [(uuid.UUID(entity_id(Keyword(":carol"))),)]),
        ("[:find ?n (row-number :over (:order-by ?a)) (sum ?a :over (:order-by ?a)) :where [?e :name ?n] [?e :age ?a]]", [("Alice", 2, 55), ("Bob", 1, 25)]),
        ("[:find ?n :where (reach :alice ?y) [?y :name ?n]]", [("Bob",), ("Carol",)]),
        ("[:find ?n :where [?e :name ?n] [?e :age ?a] [(/ ?a 0) ?z]]", []),
        ("[:find ?u :where [?e :name ?n] [?e :name ?n]]", []),
    ],
)
def test_queries(people, text, expected):
    assert rows(people, f"(query {text})") == expected


def test_constant_matching(spark):
    db = Database(spark)
    db.execute('(transact [[:a :k :b] [:b :v 1] [:c :v 1.0] [:d :r #uuid "%s"]])' % entity_id(Keyword(":b")))
    assert len(rows(db, "(query [:find ?e :where [?e :k :b]])")) == 1
    assert len(rows(db, "(query [:find ?e :where [?e :r :b]])")) == 1
    assert len(rows(db, "(query [:find ?x :where [?e :v 1]])")) == 0 and len(rows(db, "(query [:find ?e :where [?e :v 1]])")) == 1
    assert rows(db, "(query [:find ?b :where [?e :k ?b] [?b :v ?x]])") == [(Keyword(":b"),)]


def test_bitemporal(spark):
    db = Database(spark)
    db.execute('(transact [[:e :salary 100 {:valid-from "2020-01-01" :valid-to "2022-01-01"}] [:e :salary 100 {:valid-from "2024-01-01" :valid-to "2026-01-01"}]])')
    at = lambda t: len(rows(db, f'(query [:find ?s :valid-at "{t}" :where [:e :salary ?s]])'))
    assert [at(t) for t in ("2020-01-01", "2021-12-31", "2022-01-01", "2023-06-01", "2025-01-01")] == [1, 1, 0, 0, 1]
    assert rows(db, "(query [:find ?f :any-valid-time :where [:e :salary ?s] [:e :db/valid-from ?f]])") == [(1577836800000,), (1704067200000,)]
    with pytest.raises(ParseError):
        db.execute("(query [:find ?f :where [:e :salary ?s] [:e :db/valid-from ?f]])")
    db.execute("(retract [[:e :salary 100]])")
    assert rows(db, "(query [:find ?s :any-valid-time :where [:e :salary ?s]])") == []
    assert len(rows(db, "(query [:find ?s :as-of 1 :any-valid-time :where [:e :salary ?s]])")) == 2
    db.execute('(transact [[:e :salary 100 {:valid-from "2030-01-01"}]])')
    assert len(rows(db, "(query [:find ?s :any-valid-time :where [:e :salary ?s]])")) == 1


def test_rules(spark):
    db = Database(spark)
    db.execute("(transact [[:a :next :b] [:b :next :c] [:c :next :a] [:c :next :d] [:a :start true] [:d :blocked true]])")
    for r in ("[(even ?x) [?x :start true]]", "[(odd ?y) (even ?x) [?x :next ?y]]", "[(even ?y) (odd ?x) [?x :next ?y]]", "[(to ?x ?y) [?x :next ?y]]", "[(to ?x ?y) (to ?x ?z) (to ?z ?y)]", "[(free ?x) (odd ?x) (not [?x :blocked true])]"):
        db.execute(f"(rule {r})")
    assert len(rows(db, "(query [:find ?x ?y :where (to ?x ?y)])")) == 12
    assert len(rows(db, "(query [:find ?y :where (to :d ?y)])")) == 0
    assert len({entity_id(x[0]) for x in rows(db, "(query [:find ?x :where (free ?x)])")}) == 3
    with pytest.raises(ParseError):
        db.execute("(rule [(bad ?x) [?x :start true] (not (bad ?x))])")
    assert "bad" not in db.registry.rules
    with pytest.raises(LimitError):
        db.execute("(query [:find ?x ?y :max-results 3 :where (to ?x ?y)])")


def test_write_transaction(spark):
    db = Database(spark)
    with db.begin_write() as w:
        w.execute('(transact [[:z :name "Zed"]])')
        assert w.execute("(query [:find ?n :where [:z :name ?n]])").rows() == [("Zed",)]
        assert rows(db, "(query [:find ?n :where [:z :name ?n]])") == []
    assert rows(db, "(query [:find ?n :where [:z :name ?n]])") == [("Zed",)]
    w = db.begin_write()
    w.execute('(transact [[:z :name "Other"]])')
    w.rollback()
    assert db.log.last == 1


def test_file_log(spark, tmp_path):
    path = str(tmp_path / "log")
    Database(spark, path).execute('(transact [[:a :name "A"]])')
    db = Database(spark, path)
    db.execute('(transact [[:a :name "B"]])')
    assert db.log.last == 2 and len(rows(db, "(query [:find ?n :where [:a :name ?n]])")) == 2


def test_prepared_and_functions(people):
    p = people.prepare("(query [:find ?n :as-of $t :valid-at $v :where [$e :name ?n]])")
    assert p.execute({"e": Entity(Keyword(":bob")), "t": TxCount(1), "v": ANY_VALID_TIME, "more": 1}).rows() == [("Bob",)]
    with pytest.raises(KeyError):
        p.execute({})
    with pytest.raises(TypeError):
        p.execute({"e": 1, "t": TxCount(1), "v": ANY_VALID_TIME})
    people.register_aggregate("geomean", lambda: 0.0, lambda s, x: s + math.log(x), lambda s, n: math.exp(s / n))
    assert rows(people, "(query [:find (geomean ?a) (count ?e) :where [?e :age ?a]])")[0][0] == pytest.approx(math.sqrt(750))
    people.register_predicate("young?", lambda x: isinstance(x, int) and x < 28)
    assert rows(people, "(query [:find ?n :where [?e :name ?n] [?e :age ?a] [(young? ?a)]])") == [("Bob",)]
    with pytest.raises(ValueError):
        people.register_aggregate("sum", None, None, None)
    with pytest.raises(ParseError):
        people.execute("(query [:find (nope ?n) :where [?e :none ?n]])")
    with pytest.raises(Exception, match="no number"):
        rows(people, "(query [:find (sum ?n) :where [?e :name ?n]])")


def test_kinds_of_entities(spark):
    db = Database(spark)
    db.register("a", spark.createDataFrame([(1, "x"), (2, "y")], "id long, n string"), "id")
    db.register("b", spark.createDataFrame([(1, 2, 7), (2, 9, 1)], "id long, a_id long, z long"), "id", {"a_id": "a"})
    db.execute('(transact [[:k :m 1] [:k :n "x"]])')
    assert rows(db, "(query [:find ?x ?n :where [?x :a/n ?n] [?x :b/z ?z]])") == []
    assert rows(db, "(query [:find ?x :where [?x :a/n ?n] [?b :b/z ?x]])") == []
    assert rows(db, "(query [:find ?b ?n :where [?b :b/a_id ?a] [?a :a/n ?n]])") == [(1, "y")]
    assert rows(db, "(query [:find ?b :where [?b :b/a_id 9]])") == [(2,)]
    assert rows(db, "(query [:find ?a ?v :where [7 ?a ?v]])") == []
    assert {r[0].name for r in rows(db, "(query [:find ?a ?v :where [1 ?a ?v]])")} == {":a/id", ":a/n", ":b/id", ":b/a_id", ":b/z"}
    assert rows(db, "(query [:find ?v :where [1 :b/a_id ?v]])") == [(2,)] and rows(db, "(query [:find ?v :where [1 ?a ?v] [(> ?v 6)]])") == [(7,)]
    assert len(rows(db, "(query [:find ?e ?a ?v :where [?e ?a ?v]])")) == 2 + 4 + 6
    assert rows(db, '(query [:find ?e ?a :where [?e ?a "x"]])') == sorted([(uuid.UUID(entity_id(Keyword(":k"))), Keyword(":n")), ("a/1", Keyword(":a/n"))], key=repr)
    assert rows(db, "(query [:find ?a :where [?e :a/n \"x\"] [?e ?a _]])") == [(Keyword(":a/id"),), (Keyword(":a/n"),)]


def test_windows_over_mixed_numbers(spark):
    db = Database(spark)
    db.execute("(transact [[:a :v 2] [:b :v 1.5] [:c :v 3] [:d :v 2.0]])")
    got = {(r[0], type(r[0])): r[1:] for r in db.execute("(query [:find ?v (rank :over (:order-by ?v)) (min ?v :over (:order-by ?v :desc)) (row-number :over (:order-by ?v)) :where [?e :v ?v]])").rows()}
    assert {k: r[0] for k, r in got.items()} == {(1.5, float): 1, (2, int): 2, (2.0, float): 2, (3, int): 4}
    assert got[1.5, float][1] == 1.5 and got[3, int][1] == 3 and {r[2] for r in got.values()} == {1, 2, 3, 4}


def test_windows_without_partitions(spark):
    db = Database(spark)
    data = [(i, (i * 37) % 50, float((i * 7) % 11) if i % 9 else None) for i in range(200)]
    db.register("t", spark.createDataFrame(data, "id long, z long, r double").repartition(7), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(db, "(query [:find ?i (row-number :over (:order-by ?i)) (rank :over (:order-by ?z :desc)) (sum ?z :over (:order-by ?i)) (avg ?z :over (:order-by ?i)) (min ?z :over (:order-by ?i)) (max ?z :over (:order-by ?i)) (count ?z :over (:order-by ?i)) :where [?e :t/id ?i] [?e :t/z ?z]])")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    zs = [z for _, z, _ in data]
    want = [(i, i + 1, 1 + sum(x > z for x in zs), sum(zs[: i + 1]), pytest.approx(sum(zs[: i + 1]) / (i + 1)), min(zs[: i + 1]), max(zs[: i + 1]), i + 1) for i, z, _ in data]
    assert sorted(got) == want


def test_user_aggregate_over_a_window(spark):
    db = Database(spark)
    db.register("t", spark.createDataFrame([(i, i % 3, i * i % 17) for i in range(40)], "id long, g long, z long"), "id")
    db.register_aggregate("last-two", list, lambda s, x: [*s[-1:], x], lambda s, n: sum(s) * 100 + n, returns="int")
    for part, group in ((":partition-by ?g ", lambda i: i % 3), ("", lambda i: 0)):
        got = rows(db, f"(query [:find ?i (last-two ?z :over ({part}:order-by ?i)) :where [?e :t/id ?i] [?e :t/g ?g] [?e :t/z ?z]])")
        before = {i: [j for j in range(i + 1) if group(j) == group(i)] for i in range(40)}
        assert sorted(got) == [(i, sum(j * j % 17 for j in js[-2:]) * 100 + len(js)) for i, js in before.items()]


def test_demand(spark, monkeypatch):
    from kairolog.operators.rules import Evaluator

    derived, real = [], Evaluator.fixpoint

    def counted(self, group, given=None):
        real(self, group, given)
        derived.append({k: b.df.count() for (k, _), b in self.found.items() if "\0" not in k})

    monkeypatch.setattr(Evaluator, "fixpoint", counted)
    db = Database(spark)
    db.execute("(transact [[:a :next :b] [:b :next :c] [:c :next :d] [:x :next :y] [:y :next :x] [:c :od :q]])")
    for r in ("(ev ?x ?y) [?x :next ?y]", "(od ?x ?y) [?x :next ?z] (ev ?z ?y)", "(ev ?x ?y) [?x :next ?z] (od ?z ?y)", "(far ?x ?y) [?x :next ?y]", "(far ?x ?y) (far ?x ?z) [?z :next ?w] (far ?w ?y)"):
        db.execute(f"(rule [{r}])")
    every = lambda q: {tuple(entity_id(x) for x in r) for r in rows(db, q)}
    for p in ("od", "far"):
        whole = every(f"(query [:find ?x ?y :where ({p} ?x ?y)])")
        for k in (":a",) if p == "far" else (":x", ":nobody"):
            name = entity_id(Keyword(k))
            assert {(name, *r) for r in every(f"(query [:find ?y :where ({p} {k} ?y)])")} == {r for r in whole if r[0] == name}, (p, k)
    assert {(*r, entity_id(Keyword(":d"))) for r in every("(query [:find ?x :where (far ?x :d)])")} == {r for r in whole if r[1] == entity_id(Keyword(":d"))}
    derived.clear()
    rows(db, "(query [:find ?y :where (od :b ?y)])")
    assert max(derived[-1].values()) <= 3  # of the cycle that :b doesn't reach, nothing


def test_long_chain(spark):
    db = Database(spark)
    db.register("n", spark.createDataFrame([(i, i + 1) for i in range(150)], "id long, to long"), "id", {"to": "n"})
    db.execute("(rule [(reach ?x ?y) [?x :n/to ?y]])")
    db.execute("(rule [(reach ?x ?y) [?x :n/to ?z] (reach ?z ?y)])")
    assert rows(db, "(query [:find (count ?y) :where (reach 3 ?y)])") == [(147,)]
    assert rows(db, "(query [:find (count ?x) :where (reach ?x ?y)])") == [(150 * 151 // 2,)]
    db.execute("(rule [(to ?x ?y) [?x :n/to ?y]])")
    db.execute("(rule [(to ?x ?y) (to ?x ?z) (to ?z ?y)])")
    assert rows(db, "(query [:find (count ?x) :where (to ?x 150)])") == [(150,)]


def test_file_log_counter_load_and_compaction(spark, tmp_path):
    from kairolog.sources.log import FACTS, FactLog

    path = str(tmp_path / "log")
    db = Database(spark, path)
    db.log.compact_every = 3
    for i in range(4):
        db.execute(f"(transact [[:e{i} :n {i}] [:e{i} :s \"t\"]])")
    db.execute("(retract [[:e0 :n 0]])")
    assert db.log.last == 5 and db.log.generation() == 2 and db.log.folder.names() == ["_tx", "_whole-2", "data-2"]
    again = Database(spark, path)
    assert again.log.last == 5 and rows(again, "(query [:find ?n :where [?e :n ?n] [?e :s ?s]])") == [(1,), (2,), (3,)]
    more = spark.createDataFrame([("x", ":n", (1, None, 9, None, None), 50, 9, 0, (1 << 63) - 1, True)] * 2, FACTS)
    again.log.load(more)
    again.log.load(more)
    assert again.log.last == 9 and rows(again, "(query [:find (count ?n) :where [?e :n ?n]])") == [(4,)]
    assert again.log.facts().where("e = 'x'").count() == 1
    assert rows(again, "(query [:find (count ?n) :as-of 4 :any-valid-time :where [?e :n ?n]])") == [(4,)]
    first, second = FactLog(spark, path), FactLog(spark, path)
    first.take()
    with pytest.raises(RuntimeError):
        second.take()


def test_stream_and_commits(spark, tmp_path):
    from kairolog.sources.log import FactLog
    from kairolog.streaming.ingest import append_facts, write_batch

    path, source = str(tmp_path / "log"), str(tmp_path / "in")
    schema = "e string, a string, v struct<t:tinyint,s:string,i:bigint,f:double,b:boolean>, valid_from bigint, valid_to bigint, asserted boolean"
    batch = lambda e, n: spark.createDataFrame([(e, ":n", (1, None, n, None, None), None, None, True)], schema)
    Database(spark, path).execute("(transact [[:k :n 1]])")
    for e, n in (("p", 2), ("q", 3)):
        batch(e, n).write.mode("append").parquet(source)
        append_facts(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "check")).awaitTermination()
    db = Database(spark, path)
    assert db.log.last == 3 and rows(db, "(query [:find ?n :where [?e :n ?n]])") == [(1,), (2,), (3,)]
    db.execute("(transact [[:m :n 4]])")
    log = FactLog(spark, path)
    write_batch(log, batch("r", 5), "other", 0)
    log.folder.delete("_batches/other-0.whole")  # as if it had died after writing
    write_batch(FactLog(spark, path), batch("r", 5), "other", 0)
    write_batch(FactLog(spark, path), batch("r", 6), "other", 0)  # whole: passed over
    db = Database(spark, path)
    assert db.log.last == 5 and rows(db, "(query [:find ?n :where [?e :n ?n]])") == [(1,), (2,), (3,), (4,), (5,)]


def test_text_and_repl(spark):
    import io

    from kairolog.__main__ import depth, repl

    out = io.StringIO()
    lines = ["(transact [[:a :n \"x(\"]\n", "  [:b :n 2]])\n", "# a comment (\n", "(query [:find ?n\n", " :where [?e :n ?n]])\n", "(query [:find ?n :where [?e :n ?n])]\n", "(nonsense)\n", "(query [:find (count ?e) :where [?e :n _]])\n", "EXIT\n", "(nonsense)\n"]
    repl(Database(spark), lines, out)
    said = out.getvalue().splitlines()
    assert said[0].isdigit() and said[1] == "?n" and sorted(said[2:4]) == ['"x("', "2"]
    assert sum(x.startswith("error") for x in said) == 2 and said[-1] == "2"
    assert depth('(a "(" ; (\n') == 1 and depth("(a)") == 0


def test_more_of_the_notation(spark):
    db = Database(spark)
    db.execute('(transact [[:a :tag :x] [:a :f true] [:b :tag :y] [:c :tag :z] [:c :g true] [:d :self :d] [:a :self :b]])')
    names = lambda q: {entity_id(r[0]) for r in rows(db, q)}
    ids = lambda *k: {entity_id(Keyword(f":{x}")) for x in k}
    assert names("(query [:find ?e :where [?e :tag ?t] (or (and [?e :f true] (or [?e :tag :x] [?e :tag :y])) [?e :g true])])") == ids("a", "c")
    assert names("(query [:find ?e :where [?e :self ?e]])") == ids("d")
    found = db.execute("(query [:find ?t (count ?e) (count ?e) :where [?e :tag ?t]])")
    assert found.df.columns == ["?t", "(count ?e)", "(count ?e)#2"] and found.text().splitlines()[0] == "?t\t(count ?e)\t(count ?e)#2"
    db.register_predicate("odd-name?", lambda x: str(x).endswith("x"))
    db.execute("(rule [(odd ?e) [?e :tag ?t] (or [(odd-name? ?t)] [?e :g true])])")
    assert names("(query [:find ?e :where (odd ?e)])") == ids("a", "c")
    with pytest.raises(ParseError):
        db.execute("(query [:find ?e :where [?e :tag ?t] [(no-such? ?t)]])")
    assert rows(db, '(query [:find ?m :valid-at "2024-01-01" :where [?e :tag :x] [?e :db/valid-at ?m]])') == []
    db.execute('(transact {:valid-from "2023-01-01" :valid-to "2025-01-01"} [[:old :tag :w]])')
    assert rows(db, '(query [:find ?m :valid-at "2024-01-01" :where [?e :tag :w] [?e :db/valid-at ?m]])') == [(1704067200000,)]
    assert names("(query [:find ?e :where [?e :tag :w]])") == set()  # no longer true now


def hub(spark, n=1100):
    """n edges into a node and n out of it, which close to n * n + 2 * n pairs: more than a million from 1,100."""
    into, out = spark.range(1, n + 1).selectExpr("id AS a", "5000L AS b"), spark.range(1, n + 1).selectExpr("5000L AS a", "6000 + id AS b")
    return into.union(out)


STEPS = "(rule [(up ?x ?y) [?e :edge/a ?x] [?e :edge/b ?y]]) (rule [(up ?x ?y) [?e :edge/a ?x] [?e :edge/b ?z] (up ?z ?y)])"


def test_closure_without_limit(spark):
    db = Database(spark)
    db.register("edge", hub(spark))
    db.execute_script(STEPS)
    df = db.execute("(query [:find ?x ?y :where (up ?x ?y)])").df
    assert df.count() == 1100 * 1100 + 2200


@pytest.mark.parametrize("limit", [{"max_derived_facts": 50}, {"max_results": 50}])
def test_given_limits_hold(spark, limit):
    db = Database(spark, **limit)
    db.register("edge", hub(spark, 10))
    db.execute_script(STEPS)
    with pytest.raises(LimitError):
        db.execute("(query [:find ?x ?y :where (up ?x ?y)])")
    assert db.execute("(query [:find ?x ?y :max-derived-facts 200 :max-results 200 :where (up ?x ?y)])").df.count() == 120


def test_two_constants_derive_what_they_reach(spark):
    """Edges i -> i // 2: a closure of thousands of pairs, of which two constants reach 15."""
    edges = spark.range(2, 1000).selectExpr("id AS a", "id div 2 AS b")
    up = lambda x: {(x, x >> k) for k in range(1, x.bit_length())}
    other = "(rule [(up ?x ?y) [?e :edge/a ?x] [?e :edge/b ?y]]) (rule [(up ?x ?y) (up ?x ?z) [?e :edge/a ?z] [?e :edge/b ?y]])"
    for rules in (STEPS, other):
        db = Database(spark, max_results=20)
        db.register("edge", edges)
        db.execute_script(rules)
        assert set(rows(db, "(query [:find ?y ?z :where (up 500 ?y) (up 99 ?z)])")) == {(y, z) for _, y in up(500) for _, z in up(99)}
        assert set(rows(db, "(query [:find ?y :where (or (up 500 ?y) (up 99 ?y))])")) == {(y,) for _, y in up(500) | up(99)}
        assert set(rows(db, "(query [:find ?x :where (or (up ?x 499) (up ?x 250))])")) == {(998,), (999,), (500,), (501,)}
        assert rows(db, "(query [:find ?y ?z :where (up 500 ?y) (up :none ?z)])") == []


def test_constants_in_other_rules_derive_what_they_reach(spark):
    edges = spark.range(2, 1000).selectExpr("id AS a", "id div 2 AS b")
    db = Database(spark, max_results=20)
    db.register("edge", edges)
    db.execute_script(STEPS + "(rule [(apart ?x) [?e :edge/a ?x] (not (up ?x 100))]) (rule [(either ?x) (or (up ?x 100) (up ?x 124))])")
    below = lambda y: {x for x in range(2, 1000) if any(x >> k == y for k in range(1, 10))}
    assert {x for x, in rows(db, "(query [:find ?x :where (apart ?x)])")} == set(range(2, 1000)) - below(100)
    assert {x for x, in rows(db, "(query [:find ?x :max-results 100 :where (either ?x) (not (up ?x 25))])")} == below(100) - below(25) | below(124)
    assert len(rows(db, "(query [:find ?x ?y :max-results 100000 :where (apart ?x) (up ?x ?y)])")) == sum(x.bit_length() - 1 for x in set(range(2, 1000)) - below(100))


def test_composed_closure_without_limit(spark):
    db = Database(spark)
    db.register("edge", hub(spark))
    db.execute_script("(rule [(to ?x ?y) [?e :edge/a ?x] [?e :edge/b ?y]]) (rule [(to ?x ?y) (to ?x ?z) (to ?z ?y)])")
    assert db.execute("(query [:find ?x ?y :where (to ?x ?y)])").df.count() == 1100 * 1100 + 2200


def test_mutual_rules_without_limit(spark):
    db = Database(spark)
    db.register("edge", spark.range(1, 1_100_001).selectExpr("id AS a", "IF(id = 1, 0L, 1L) AS b"))
    db.execute_script("(rule [(even ?x) [?e :edge/a ?x] [?e :edge/b 0]]) (rule [(odd ?x) [?e :edge/a ?x] [?e :edge/b ?y] (even ?y)]) (rule [(even ?x) [?e :edge/a ?x] [?e :edge/b ?y] (odd ?y)])")
    assert db.execute("(query [:find ?x :where (odd ?x)])").df.count() == 1_099_999


def test_log_closure_without_limit(spark):
    facts = hub(spark).selectExpr("concat('u', a) AS e", "':up' AS a", "named_struct('t', 4Y, 's', concat('u', b), 'i', CAST(NULL AS BIGINT), 'f', CAST(NULL AS DOUBLE), 'b', CAST(NULL AS BOOLEAN)) AS v", "0L AS tx_id", "1L AS tx_count", "0L AS valid_from", "9223372036854775807L AS valid_to", "true AS asserted")
    db = Database(spark, facts=facts)
    db.execute_script("(rule [(above ?x ?y) [?x :up ?y]]) (rule [(above ?x ?y) [?x :up ?z] (above ?z ?y)])")
    assert db.execute("(query [:find ?x ?y :where (above ?x ?y)])").df.count() == 1100 * 1100 + 2200
