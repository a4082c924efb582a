"""Rules: stratification, and evaluation to a fixpoint, semi-naively, one strongly connected group after another.

Each round joins only what the last one found. Rules that a query asks with constants are rewritten first so that only
what the query demands is derived (``demanded``). A linear closure of two arguments is walked along its edges; from a
constant, only what that reaches is visited. Long walks change over to edges of two, four, eight ... steps, as long as
those don't outgrow the edges by much, so a chain takes a logarithmic number of rounds.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairolog.functions.values import KW, Val, entity_id, key, keyword_id, literal, same
from kairolog.operators.compile import Bindings, Compiler, converted, unioned
from kairolog.plans.edn import Keyword
from kairolog.plans.parse import Const, Invoke, Not, Or, ParseError, Pattern, Rule, Var, mentions
from kairolog.sources.shared import keep

ROUNDS = 1000
STEPS, SINGLE, WIDER = 4, 3, 8  # steps in a round; rounds of single steps before longer ones; how many times the edges these may be
DELTA = "\0"
Seed = tuple[int, list[Const]]


def _named(clauses: tuple, names: dict[str, str]) -> tuple | None:
    """Patterns with their variables renamed; None if there are other clauses or variables."""
    if not all(isinstance(c, Pattern) for c in clauses) or mentions(clauses) - set(names):
        return None
    term = lambda t: Var(names[t.name]) if isinstance(t, Var) else t
    return tuple(Pattern(term(c.e), term(c.a), term(c.v)) for c in clauses)


class Reach:
    """The pairs that walks of at most so many steps join, twice as many after each ``lengthen``."""

    def __init__(self, hop: DataFrame, ident: Callable[[Column], Column]) -> None:
        self.pairs, self.exact, self.size, self.ident = hop, hop, hop.count(), ident

    def lengthen(self) -> int:
        """The number of new pairs. One job: walks of exactly so many steps, followed by as many (1) or fewer (0)."""
        first = self.exact.select("s", self.ident(F.col("t")).alias("m"))
        second = self.pairs.select(F.col("s").alias("m"), "t", F.lit(0).alias("k")).unionByName(self.exact.select(F.col("s").alias("m"), "t", F.lit(1).alias("k")))
        found = first.join(second, "m").select("s", "t", "k").distinct()
        found = keep(found.join(self.pairs.select("s", "t", F.lit(0).alias("k")), ["s", "t", "k"], "left_anti"))
        new = found.where("k = 0").select("s", "t")
        n = new.count()
        self.pairs, self.exact, self.size = self.pairs.unionByName(new), found.where("k = 1").select("s", "t"), self.size + n
        return n


class LimitError(RuntimeError):
    pass


def invocations(clauses: tuple, negative: bool = False) -> list[tuple[Invoke, bool]]:
    out = []
    for c in clauses:
        if isinstance(c, Invoke):
            out.append((c, negative))
        elif isinstance(c, Not):
            out += invocations(c.body, True)
        elif isinstance(c, Or):
            out += [x for b in c.branches for x in invocations(b, negative)]
    return out


def groups(rules: dict[str, list[Rule]]) -> list[set[str]]:
    """Strongly connected groups of predicates, callees first."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, out = [], []

    def visit(p: str) -> None:
        index[p] = low[p] = len(index)
        stack.append(p)
        for r in rules[p]:
            for q in {x.name for x, _ in invocations(r.body)} & set(rules):
                if q not in index:
                    visit(q)
                    low[p] = min(low[p], low[q])
                elif q in stack:
                    low[p] = min(low[p], index[q])
        if low[p] == index[p]:
            at = stack.index(p)
            out.append(set(stack[at:]))
            del stack[at:]

    for p in rules:
        if p not in index:
            visit(p)
    return out


class Registry:
    def __init__(self) -> None:
        self.rules: dict[str, list[Rule]] = {}

    def register(self, r: Rule) -> None:
        """Refused, without a trace, if a negation would lie on a cycle."""
        tried = {k: list(v) for k, v in self.rules.items()}
        if any(len(x.args) != len(r.args) for x in tried.get(r.name, ())):
            raise ParseError(f"{r.name} has another number of arguments")
        tried.setdefault(r.name, []).append(r)
        for group in groups(tried):
            for p in group:
                if any(neg and x.name in group for rule in tried[p] for x, neg in invocations(rule.body)):
                    raise ParseError(f"{p} depends on its own negation")
        self.rules = tried

    def reachable(self, names: set[str]) -> dict[str, list[Rule]]:
        seen, todo = set(), [n for n in names if n in self.rules]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [x.name for r in self.rules[n] for x, _ in invocations(r.body) if x.name in self.rules]
        return {n: self.rules[n] for n in self.rules if n in seen}


class Evaluator:
    def __init__(self, compiler: Compiler, registry: Registry, where: tuple, base_facts: bool, limits: dict[str, int | None]) -> None:
        self.compiler, self.found, self.base_facts = compiler, {}, base_facts
        self.max_round, self.max_total, self.total = limits.get(":max-derived-facts"), limits.get(":max-results"), 0
        compiler.derived = lambda x: self.found.get((x.name, len(x.args)))
        asked: dict[str, list[Invoke]] = defaultdict(list)
        for x, _ in invocations(where):
            asked[x.name].append(x)
        self.rules = registry.reachable(set(asked))
        every = defaultdict(list, {p: list(xs) for p, xs in asked.items()})  # what the query and other rules ask
        for r in (r for rs in self.rules.values() for r in rs):
            for x, _ in invocations(r.body):
                if x.name != r.name:
                    every[x.name].append(x)
        for group in groups(self.rules):
            name = min(group)
            recursive = len(group) > 1 or any(x.name == name for r in self.rules[name] for x, _ in invocations(r.body))
            calls = {p: asked[p] for p in group if p in asked}
            if not recursive:
                self.found[name, len(self.rules[name][0].args)] = self.union([self.head(r) for r in self.rules[name]] + self.base(name))
            elif len(group) > 1 or not self.linear(name, self.seed(every[name])):
                outside = {x.name for p, rs in self.rules.items() if p not in group for r in rs for x, _ in invocations(r.body)}
                if not (group & outside) and self.demanded(group, calls):
                    continue
                self.fixpoint(group)
        for name, calls in asked.items():
            for x in calls:
                if (name, len(x.args)) not in self.found:
                    if name in self.rules:
                        raise ParseError(f"{name} has another number of arguments")
                    if not (base := self.base(name, len(x.args))):
                        raise ParseError(f"unknown rule {name}")
                    self.found[name, len(x.args)] = self.union(base)

    def seed(self, calls: list[Invoke]) -> Seed | None:
        """(argument, constants) if all invocations hold a constant there; the argument with fewer of them."""
        found = []
        for i in (0, 1):
            held = {repr(x.args[i].value) if len(x.args) == 2 and isinstance(x.args[i], Const) else None: x.args[i] for x in calls if len(x.args) == 2}
            if held and None not in held and all(len(x.args) == 2 for x in calls):
                found.append((i, list(held.values())))
        return min(found, key=lambda s: len(s[1]), default=None)

    def base(self, name: str, arity: int | None = None) -> list[Bindings]:
        """Facts under the attribute of the rule's name count as derived."""
        if not self.base_facts or "\1" in name or "\2" in name:
            return []
        arity = arity or len(self.rules[name][0].args)
        value = Var("1") if arity == 2 else Const(True)
        found = self.compiler.log_scan(Pattern(Var("0"), Const(Keyword(":" + name)), value), [])
        return [found.only(["0", "1"][:arity])]

    def head(self, r: Rule, body: tuple | None = None) -> Bindings:
        b = self.compiler.conjunction(r.body if body is None else body)
        kinds = {str(i): (f"h{i}", b.vars[t.name][1]) for i, t in enumerate(r.args)}
        return Bindings(b.df.select(*(b.val(t.name).col.alias(f"h{i}") for i, t in enumerate(r.args))), kinds)

    def union(self, parts: list[Bindings]) -> Bindings:
        return unioned(parts, list(parts[0].vars))

    # linear recursion of one predicate

    def linear(self, name: str, seed: Seed | None) -> bool:
        """Whether it was evaluated here: base rules, and rules (p ?x ?y) that step from (p ?z ?y) or (p ?x ?z)."""
        base, steps, composed = [], [], False
        for r in self.rules[name]:
            own = [c for c in r.body if isinstance(c, Invoke) and c.name == name]
            if not any(x.name == name for x, _ in invocations(r.body)):
                base.append(r)
                continue
            rest = tuple(c for c in r.body if c not in own)
            if self.composes(r, own, rest):
                composed = True
                continue
            if len(own) != 1 or len(r.args) != 2 or len({t.name for t in r.args}) != 2 or any(x.name == name for x, _ in invocations(rest)) or not all(isinstance(t, Var) for t in own[0].args):
                return False
            x, y, (a, b) = r.args[0].name, r.args[1].name, (t.name for t in own[0].args)
            names = {t.name for c in rest if isinstance(c, (Pattern, Invoke)) for t in ((c.e, c.v) if isinstance(c, Pattern) else c.args) if isinstance(t, Var)}
            if b == y and a != x and {x, a} <= names and y not in names:
                steps.append((0, rest, (x, a)))
            elif a == x and b != y and {b, y} <= names and x not in names:
                steps.append((1, rest, (b, y)))
            else:
                return False
        if composed and not steps and base:  # the closure of the base rules
            start = self.union([self.head(r) for r in base] + self.base(name))
            return self.closed(name, start, start, 0 if seed is None else seed[0], seed, True)
        if composed or not base or len({s[0] for s in steps}) != 1:
            return False
        side = steps[0][0]
        edges = [self.compiler.conjunction(rest) for _, rest, _ in steps]
        edges = self.union([Bindings(e.df.select(e.val(a).col.alias("h0"), e.val(b).col.alias("h1")), {"0": ("h0", e.vars[a][1]), "1": ("h1", e.vars[b][1])}) for e, (_, _, (a, b)) in zip(edges, steps, strict=True)])
        start = self.union([self.head(r) for r in base] + self.base(name))
        (_, rest, ends), r = steps[0], base[0]
        alike = len(base) == len(steps) == 1 and not self.base_facts and _named(rest, dict(zip(ends, (t.name for t in r.args), strict=True))) == r.body
        return self.closed(name, start, edges, side, seed, alike)

    @staticmethod
    def composes(r: Rule, own: list[Invoke], rest: tuple) -> bool:
        """(p ?x ?y) from (p ?x ?z) and (p ?z ?y)."""
        if rest or len(own) != 2 or len(r.args) != 2 or not all(isinstance(t, Var) for x in own for t in x.args):
            return False
        (x, y), ((a, b), (c, d)) = (t.name for t in r.args), ((t.name for t in z.args) for z in own)
        return x != y and any(p == x and q == r_ and s_ == y and q not in (x, y) for p, q, r_, s_ in ((a, b, c, d), (c, d, a, b)))

    def closed(self, name: str, start: Bindings, edges: Bindings, side: int, seed: Seed | None, alike: bool) -> bool:
        """``alike``: what it starts with are the edges themselves."""
        kinds = {k for b in (edges, start) for _, k in b.vars.values()}
        if len(kinds) > 1 or kinds & {"any", "kw"}:  # a keyword and the entity it names meet: tagged values, joined by key
            edges, start = (b.aligned({n: (c, "any") for n, (c, _) in b.vars.items()}) for b in (edges, start))
        elif alike and seed is None:
            (c0, _), (c1, _) = start.vars.values()
            e0, e1 = (c for c, _ in edges.vars.values())
            reach = Reach(keep(edges.df.select(F.col(e0).alias("s"), F.col(e1).alias("t")).distinct()), lambda c: c)
            while n := reach.lengthen():
                self.count(n)
            self.found[name, 2] = Bindings(reach.pairs.select(F.col("s").alias(c0), F.col("t").alias(c1)), start.vars)
            return True
        self.found[name, 2] = self.stepped(start, edges, side, seed)
        return True

    @staticmethod
    def const(t: Const, kind: str) -> Val:
        """A constant as a value that can meet those of the kind."""
        if kind.startswith("ent:") and type(t.value) is int:
            return Val(kind, F.lit(t.value).cast("bigint"))
        v = literal(t.value)
        return v.tagged() if kind == "any" else Val("ref", F.lit(entity_id(t.value))) if kind == "ref" and isinstance(t.value, (Keyword, uuid.UUID)) else v

    def stepped(self, start: Bindings, edges: Bindings, side: int, seed: Seed | None) -> Bindings:
        """Rounds of joins. From seeds on the moving side, only what they reach is visited."""
        (c0, kind), (c1, _) = start.vars["0"], start.vars["1"]
        ident = (lambda c: key(Val("any", c))) if kind == "any" else lambda c: c
        e0, e1 = (c for c, _ in edges.vars.values())
        near, far = (e1, e0) if side == 0 else (e0, e1)
        values = [] if seed is None else [self.const(t, kind) for t in seed[1]]
        if seed is not None and seed[0] == side:
            values = [v for v in values if v.kind == kind]
            if not values:
                return start.where(F.lit(False))
            hop = edges.df.select(ident(F.col(far)).alias("s"), F.col(near).alias("t"))
            moving, fixed = (c0, c1) if side == 0 else (c1, c0)
            if len(values) == 1:
                reached = self.walk(self.compiler.spark.range(1).select(values[0].col.alias("x")), "x", hop, ident).withColumn("from", values[0].col)
            else:  # each goes its own way
                reached = self.walk(self.compiler.spark.range(1).select(F.explode(F.array(*(v.col for v in values))).alias("x")).select(F.col("x").alias("from"), "x"), "x", hop, ident)
            df = start.df.select(ident(F.col(moving)).alias("at"), F.col(fixed).alias("end")).join(reached.select("from", ident(F.col("x")).alias("at")), "at")
            return Bindings(df.select(F.col("from").alias(moving), F.col("end").alias(fixed)).distinct().select(c0, c1), start.vars)
        begin = start if seed is None else start.where(reduce(or_, (same(start.val(str(seed[0])), v) for v in values)))
        hop = edges.df.select(ident(F.col(near)).alias("s"), F.col(far).alias("t"))
        return Bindings(self.walk(begin.df, c0 if side == 0 else c1, hop, ident), start.vars)

    def walk(self, begin: DataFrame, moving: str, hop: DataFrame, ident: Callable[[Column], Column]) -> DataFrame:
        """All that ``begin`` reaches when its column ``moving`` goes along the edges (s, t), s being the ``ident`` of where they start; rows without nulls.

        From few rows by steps from what was new last; from as many as there are edges along their closure."""
        hop = keep(hop.distinct())
        new = keep(begin.distinct())
        reach, columns, seen, parts = Reach(hop, ident), new.columns, new, 1
        edges = reach.size
        go = lambda d, h: d.join(h, ident(F.col(moving)) == F.col("s")).select(*(F.col("t").alias(c) if c == moving else F.col(c) for c in columns)).distinct()
        if new.count() * 2 >= edges:
            while n := reach.lengthen():
                self.count(n)
            return new.unionByName(go(new, reach.pairs)).distinct()
        wide = True
        for turn in range(ROUNDS):
            found, at = None, new
            for _ in range(STEPS):  # the steps share their shuffles, so a round is one job
                at = go(at, reach.pairs)
                found = at if found is None else found.unionByName(at)
            known = [F.col(f"`{c}`") == F.col(f"`__{c}`") for c in columns]
            new = keep(found.distinct().join(seen.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in columns)), known, "left_anti"))
            n = new.count()
            if not n:
                return seen
            self.count(n)
            seen, parts = seen.unionByName(new), parts + 1
            if parts % 8 == 0:
                seen = keep(seen)
            if wide and turn + 1 >= SINGLE:
                reach.lengthen()
                wide = reach.size <= WIDER * edges
        raise LimitError(f"no fixpoint in {ROUNDS} rounds")

    def count(self, n: int) -> None:
        self.total += n
        if self.max_round is not None and n > self.max_round or self.max_total is not None and self.total > self.max_total:
            raise LimitError("the rules derive more facts than allowed")

    # demand

    def demanded(self, group: set[str], calls: dict[str, list[Invoke]]) -> bool:
        """Evaluate the group for what the query asks, if every invocation of it holds a constant. Whether it was done.

        Each predicate gets a copy for each pattern of known arguments in which it is invoked, guarded by a predicate of
        demands: the constants of the query, and what the guarded rules bind before they invoke it."""
        if any(n for rs in self.rules.values() for r in rs if r.name in group for x, n in invocations(r.body) if x.name in group) or not calls:
            return False
        if any(x.name in group for p in group for r in self.rules[p] for c in r.body if isinstance(c, (Or, Not)) for x, _ in invocations((c,))):
            return False
        known = lambda x, bound: "".join("b" if isinstance(t, Const) or isinstance(t, Var) and t.name in bound else "f" for t in x.args)
        if any("b" not in known(x, ()) for xs in calls.values() for x in xs):
            return False
        copies: dict[tuple[str, str], list[Rule]] = {}
        demand: dict[str, list[Rule]] = defaultdict(list)
        seeds: dict[str, set[tuple]] = defaultdict(set)
        todo = [(p, known(x, ())) for p, xs in calls.items() for x in xs]
        for p, xs in calls.items():
            for x in xs:
                seeds[f"{p}\1{known(x, ())}"].add(tuple(t for t in x.args if isinstance(t, Const)))
        while todo:
            p, way = todo.pop()
            if (p, way) in copies or "b" not in way:
                if "b" not in way:
                    return False  # something is asked for without a bound: all of it is demanded
                continue
            copies[p, way] = []
            for r in self.rules[p]:
                if any(not isinstance(t, Var) for t in r.args) or len({t.name for t in r.args}) < len(r.args):
                    return False
                guard = Invoke(f"{p}\1{way}", tuple(t for t, w in zip(r.args, way, strict=True) if w == "b"))
                bound, body = {t.name for t in guard.args}, [guard]
                # patterns that touch what is bound come first, so that invocations find their arguments
                rest = list(r.body)
                while rest:
                    c = max(rest, key=lambda c: (not isinstance(c, Invoke) or c.name not in group, len(mentions((c,)) & bound)))
                    inner = [x for x in rest if isinstance(x, Invoke) and x.name in group and mentions((x,)) & bound]
                    if inner and not (mentions((c,)) & bound):
                        c = inner[0]
                    rest.remove(c)
                    if isinstance(c, Invoke) and c.name in group:
                        how = known(c, bound)
                        asked = tuple(t for t, w in zip(c.args, how, strict=True) if w == "b")
                        if not asked or any(isinstance(t, Const) for t in asked):
                            return False
                        demand[f"{c.name}\1{how}"].append(Rule(f"{c.name}\1{how}", asked, tuple(body)))
                        todo.append((c.name, how))
                        c = replace(c, name=f"{c.name}\2{how}")
                    body.append(c)
                    bound |= mentions((c,))
                copies[p, way].append(Rule(f"{p}\2{way}", r.args, tuple(body)))
            if self.base_facts:
                args = tuple(Var(f"?{i}") for i in range(len(way)))
                guard = Invoke(f"{p}\1{way}", tuple(t for t, w in zip(args, way, strict=True) if w == "b"))
                copies[p, way].append(Rule(f"{p}\2{way}", args, (guard, Pattern(args[0], Const(Keyword(":" + p)), args[1] if len(args) == 2 else Const(True)))))
        rules = {f"{p}\2{way}": rs for (p, way), rs in copies.items()} | {n: [r for r in rs if r.body != (Invoke(n, r.args),)] for n, rs in demand.items()}
        for n in seeds:
            rules.setdefault(n, [])
        given = {n: self.seeded(values, [k for k, w in zip(self.argument_kinds(n.split("\1")[0], group), n.split("\1")[1], strict=True) if w == "b"]) for n, values in seeds.items()}
        outer, self.rules = self.rules, {**self.rules, **rules}
        try:
            self.fixpoint(set(rules), given)
        finally:
            self.rules = outer
        for p in calls:
            parts = [self.named(self.found[f"{p}\2{way}", len(way)], way) for q, way in copies if q == p]
            self.found[p, len(self.rules[p][0].args)] = self.union(parts)
        return True

    @staticmethod
    def named(b: Bindings, way: str) -> Bindings:
        """Known arguments as entities: a demand may name one by its keyword, or as what it names, and is the same demand."""
        cols, kinds = [], {}
        for (n, (c, k)), w in zip(b.vars.items(), way, strict=True):
            v = F.col(c)
            if w == "b" and k == "kw":
                v, k = keyword_id(v), "ref"
            elif w == "b" and k == "any":
                v = F.when(v["t"] == KW, Val("ref", keyword_id(v["s"])).tagged().col).otherwise(v)
            cols.append(v.alias(c))
            kinds[n] = (c, k)
        return Bindings(b.df.select(*cols), kinds)

    def argument_kinds(self, p: str, group: set[str]) -> list[str]:
        """The kind of each argument where the rules that don't recurse agree, else ``any``; without such rules, the group's if it has one only."""
        found = {q: [[k for _, k in self.head(r).vars.values()] for r in self.rules[q] if not any(x.name in group for x, _ in invocations(r.body))] for q in group}
        if found[p]:
            return [ks[0] if len(set(ks)) == 1 else "any" for ks in zip(*found[p], strict=True)]
        every = {k for rows in found.values() for ks in rows for k in ks}
        return [min(every) if len(every) == 1 else "any"] * len(self.rules[p][0].args)

    def seeded(self, values: set[tuple], kinds: list[str]) -> Bindings:
        """The query's constants as the first demands."""
        parts = []
        for row in sorted(values, key=repr):
            vals = [self.const(t, k) for t, k in zip(row, kinds, strict=True)]
            parts.append(Bindings(self.compiler.spark.range(1).select(*(v.col.alias(f"h{i}") for i, v in enumerate(vals))), {str(i): (f"h{i}", v.kind) for i, v in enumerate(vals)}))
        out = self.union(parts)
        names = {n: (f"h{n}", k) for n, (_, k) in out.vars.items()}
        return Bindings(out.df.select(*(F.col(c).alias(names[n][0]) for n, (c, _) in out.vars.items())), names)

    # any recursion

    def fixpoint(self, group: set[str], given: dict[str, Bindings] | None = None) -> None:
        """``given``: rows that predicates of the group start with."""
        given = given or {}
        arity = {p: len(given[p].vars) if p in given else len(self.rules[p][0].args) for p in group}
        first, later = defaultdict(list), []
        for p in group:
            for r in self.rules[p]:
                own = [i for i, c in enumerate(r.body) if isinstance(c, Invoke) and c.name in group]
                if any(x.name in group for x, _ in invocations(r.body)):
                    nested = len([1 for x, _ in invocations(r.body) if x.name in group]) > len(own)
                    later.append((p, r, None if nested else own))
                else:
                    first[p].append(self.head(r))
        begin = {p: first[p] + ([given[p]] if p in given else self.base(p)) for p in group}
        seen: dict[str, Bindings] = {p: self.union(parts) for p, parts in begin.items() if parts}
        if not seen:
            for p in group:
                empty = self.compiler.spark.range(0).select(*(F.lit(None).cast("string").alias(f"h{i}") for i in range(arity[p])))
                self.found[p, arity[p]] = Bindings(empty, {str(i): (f"h{i}", "str") for i in range(arity[p])})
            return
        for p in group - set(seen):  # takes its kinds from the predicates that have some
            like = next(iter(seen.values()))
            kind = like.vars["0"][1]
            empty = like.df.limit(0).select(*(F.col(like.vars["0"][0]).alias(f"h{i}") for i in range(arity[p])))
            seen[p] = Bindings(empty, {str(i): (f"h{i}", kind) for i in range(arity[p])})
        seen = {p: Bindings(keep(b.df), b.vars) for p, b in seen.items()}
        delta = dict(seen)
        sizes = {p: 1 for p in begin if begin[p]}
        for turn in range(ROUNDS):
            for p in group:
                self.found[p, arity[p]], self.found[DELTA + p, arity[p]] = seen[p], delta[p]
            fresh: dict[str, Bindings] = {}
            for p in group:
                parts = []
                for q, r, own in later:
                    if q != p:
                        continue
                    if own is None:
                        parts.append(self.head(r))
                    for i in own or ():
                        if not sizes.get(r.body[i].name):  # nothing new there
                            continue
                        parts.append(self.head(r, tuple(replace(c, name=DELTA + c.name) if j == i else c for j, c in enumerate(r.body))))
                if not parts:
                    continue
                target = {n: ("n" + c, k) for n, (c, k) in seen[p].vars.items()}
                if any(b.vars[n][1] != k for b in parts for n, (_, k) in target.items()):
                    target = {n: (c, "any") for n, (c, _) in target.items()}
                    old = seen[p]
                    seen[p] = Bindings(old.df.select(*(converted(old.val(n), "any").alias(old.vars[n][0]) for n in old.vars)), {n: (c, "any") for n, (c, _) in old.vars.items()})
                df = parts[0].aligned(target).df
                for b in parts[1:]:
                    df = df.unionByName(b.aligned(target).df)
                known = [F.col(target[n][0]).eqNullSafe(F.col(c)) for n, (c, _) in seen[p].vars.items()]
                new = keep(df.distinct().join(seen[p].df, known, "left_anti"))
                fresh[p] = Bindings(new.select(*(F.col(target[n][0]).alias(c) for n, (c, _) in seen[p].vars.items())), seen[p].vars)
            sizes = {p: b.df.count() for p, b in fresh.items()}
            if not any(sizes.values()):
                break
            self.count(sum(sizes.values()))
            for p, b in fresh.items():
                df = seen[p].df.unionByName(b.df)
                seen[p] = Bindings(keep(df) if turn % 8 == 7 else df, seen[p].vars)
            delta = {p: fresh.get(p, Bindings(seen[p].df.limit(0), seen[p].vars)) for p in group}
        else:
            raise LimitError(f"no fixpoint in {ROUNDS} rounds")
        for p in group:
            self.found[p, arity[p]] = seen[p]
