"""Clauses to DataFrames: a set of bindings is a DataFrame with a column for each variable."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.functions.exprs import compile_expr, truthy
from kairolog.functions.values import Val, entity_id, key, literal, matches, same
from kairolog.plans.edn import Keyword
from kairolog.plans.parse import PSEUDO, Const, Expr, Invoke, Not, Or, ParseError, Pattern, Var, binds, call_vars, mentions
from kairolog.sources.relations import Relation

_fresh = itertools.count()
HIDDEN = {":db/valid-from": "valid_from", ":db/valid-to": "valid_to", ":db/tx-count": "tx_count", ":db/tx-id": "tx_id"}


@dataclass(frozen=True)
class Bindings:
    df: DataFrame
    vars: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # name: (column, kind)

    def val(self, name: str) -> Val:
        column, kind = self.vars[name]
        return Val(kind, F.col(column))

    def vals(self) -> dict[str, Val]:
        return {n: self.val(n) for n in self.vars}

    def where(self, c: Column) -> Bindings:
        return Bindings(self.df.where(c), self.vars)

    def only(self, names: list[str]) -> Bindings:
        kept = {n: self.vars[n] for n in names}
        return Bindings(self.df.select(*(c for c, _ in kept.values())), kept)

    def renamed(self) -> Bindings:
        new = {n: (f"c{next(_fresh)}", k) for n, (_, k) in self.vars.items()}
        return Bindings(self.df.select(*(F.col(c).alias(new[n][0]) for n, (c, _) in self.vars.items())), new)

    def aligned(self, kinds: Mapping[str, tuple[str, str]]) -> Bindings:
        """The columns that ``kinds`` names, converted where kinds differ."""
        return Bindings(self.df.select(*(converted(self.val(n), k).alias(c) for n, (c, k) in kinds.items())), kinds)


def converted(v: Val, kind: str) -> Column:
    return v.tagged().col if kind == "any" and v.kind != "any" else v.col


def joined(a: Bindings, b: Bindings) -> Bindings:
    shared = [n for n in b.vars if n in a.vars]
    new = {n: c for n, c in b.vars.items() if n not in a.vars}
    df = a.df.join(b.df, agree(a, b, shared)) if shared else a.df.crossJoin(b.df)
    out = {**a.vars, **new}
    return Bindings(df.select(*(c for c, _ in out.values())), out)


def agree(a: Bindings, b: Bindings, names: list[str]) -> Column:
    c = F.lit(True)
    for n in names:
        c = c & same(a.val(n), b.val(n))
    return c


def unioned(parts: list[Bindings], names: list[str], distinct: bool = True) -> Bindings:
    """The union of the parts, without repeats unless they count; kinds that differ become tagged values."""
    kinds = {n: {p.vars[n][1] for p in parts} for n in names}
    target = {n: (f"c{next(_fresh)}", k.pop() if len(k) == 1 else "any") for n, k in kinds.items()}
    df = parts[0].aligned(target).df
    for p in parts[1:]:
        df = df.unionByName(p.aligned(target).df)
    return Bindings(df.distinct() if distinct else df, target)


class Compiler:
    """``facts``: the snapshot, dealt by entity if asked. ``derived``: of a rule name, its (columns' bindings) if it is one."""

    def __init__(self, spark: SparkSession, relations: Mapping[str, Relation], facts: Callable[[bool], DataFrame], predicates: Mapping[str, Callable], valid_at: int | str, derived: Callable[[Invoke], Bindings | None] = lambda _: None) -> None:
        self.spark, self.relations, self.facts, self.predicates, self.valid_at, self.derived = spark, relations, facts, predicates, valid_at, derived

    # scans

    def relation(self, p: Pattern) -> tuple[Relation, str] | None:
        if not (isinstance(p.a, Const) and isinstance(p.a.value, Keyword) and "/" in p.a.value.name):
            return None
        table, _, column = p.a.value.name[1:].partition("/")
        found = self.relations.get(table)
        return (found, column) if found and found.attribute(column) else None

    def star(self, patterns: list[Pattern], ors: tuple[Or, ...] = ()) -> Bindings:
        """Patterns on one entity of one relation: a single scan of the columns they name. ``ors``: that ``filters`` found."""
        rel, _ = self.relation(patterns[0])
        df, cols, cond = rel.df, {}, F.lit(True)
        slots = [(patterns[0].e, rel.entity())] + [(p.v, rel.attribute(self.relation(p)[1])) for p in patterns]
        seen: dict[str, Val] = {}
        for i, (t, v) in enumerate(slots):
            if i or rel.key is not None:  # a null is no fact
                cond = cond & v.col.isNotNull()
            if isinstance(t, Const):
                cond = cond & self.is_const(v, t.value)
            elif isinstance(t, Var) and t.name in seen:
                cond = cond & same(seen[t.name], v)
            elif isinstance(t, Var):
                seen[t.name] = v
                cols[t.name] = (f"c{next(_fresh)}", v.kind)
        for o in ors:
            any_branch = F.lit(False)
            for branch in o.branches:
                held = F.lit(True)
                for c in branch:
                    if isinstance(c, Expr):
                        held = held & truthy(*compile_expr(c.call, seen, self.predicates))
                        continue
                    v = rel.attribute(self.relation(c)[1])
                    held = held & v.col.isNotNull()
                    if c.v is not None:
                        held = held & (self.is_const(v, c.v.value) if isinstance(c.v, Const) else same(seen[c.v.name], v))
                any_branch = any_branch | held
            cond = cond & any_branch
        if not cols:
            cols, seen = {"": (f"c{next(_fresh)}", "bool")}, {"": Val("bool", F.lit(True))}
        df = df.where(cond).select(*(seen[n].col.alias(c) for n, (c, _) in cols.items()))
        return Bindings(df, {n: c for n, c in cols.items() if n})

    def filters(self, clauses: tuple) -> list[Or]:
        """Of a conjunction of patterns on one entity, by its key: the disjunctions that only ask more of the same row."""
        patterns = [c for c in clauses if isinstance(c, Pattern)]
        rels = [self.relation(p) for p in patterns]
        if not patterns or None in rels or len({r.name for r, _ in rels}) > 1 or len({repr(p.e) for p in patterns}) > 1 or any(isinstance(c, Invoke) for c in clauses):
            return []
        rel, e = rels[0][0], patterns[0].e
        if rel.key is None or not isinstance(e, Var):
            return []
        bound = binds(tuple(patterns))

        def asks(c: object) -> bool:
            if isinstance(c, Pattern):
                found = self.relation(c)
                return bool(found) and found[0] is rel and c.e == e and (not isinstance(c.v, Var) or c.v.name in bound)
            return isinstance(c, Expr) and c.out is None and call_vars(c.call) <= bound

        return [c for c in clauses if isinstance(c, Or) and c.join is None and all(asks(x) for b in c.branches for x in b)]

    @staticmethod
    def is_const(v: Val, x: object) -> Column:
        return (v.col == x) if v.table and type(x) is int else matches(v, x)

    @staticmethod
    def bound(df: DataFrame, slots: list[tuple]) -> Bindings:
        """The rows of facts that the terms allow, with a column for each variable."""
        seen, cond = {}, F.lit(True)
        for i, (t, v) in enumerate(slots):
            if isinstance(t, Const) and i == 0:
                number = type(t.value) is int  # names an entity of a table only
                cond = cond & (F.lit(False) if number != bool(v.table) else v.col == (t.value if number else entity_id(t.value)))
            elif isinstance(t, Const):
                cond = cond & ((v.col == t.value.name) if i == 1 else matches(v, t.value))
            elif isinstance(t, Var) and t.name in seen:
                cond = cond & same(seen[t.name], v)
            elif isinstance(t, Var):
                seen[t.name] = v
        names = {n: (f"c{next(_fresh)}", v.kind) for n, v in seen.items()}
        return Bindings(df.where(cond).select(*(seen[n].col.alias(c) for n, (c, _) in names.items()), *([] if names else [F.lit(True).alias(f"c{next(_fresh)}")])), names)

    def log_scan(self, p: Pattern, pseudo: list[Pattern], by_entity: bool = False) -> Bindings:
        slots = [(p.e, Val("ref", F.col("e"))), (p.a, Val("kw", F.col("a"))), (p.v, Val("any", F.col("v")))]
        slots += [(q.v, Val("int", F.col(HIDDEN[q.a.value.name]))) for q in pseudo]
        return self.bound(self.facts(by_entity), slots)

    def everywhere(self, p: Pattern, pseudo: list[Pattern], tables: set[str] | None) -> Bindings:
        """A pattern whose attribute is open: over the log and all tables, or over those that the entity is known to be of."""
        parts = [] if tables else [self.log_scan(p, pseudo)]
        if not pseudo:
            for rel in (r for n, r in self.relations.items() if not tables or n in tables):
                facts = [F.struct(F.lit(f":{rel.name}/{c}").alias("a"), F.when(v.col.isNotNull(), v.tagged().col).alias("v")) for c in rel.df.columns if (v := rel.attribute(c)) is not None]
                df = rel.df.select(rel.entity().col.alias("e"), F.explode(F.array(*facts)).alias("f")).where("e IS NOT NULL AND f.v IS NOT NULL")
                parts.append(self.bound(df, [(p.e, Val(f"ent:{rel.name}", F.col("e"))), (p.a, Val("kw", F.col("f.a"))), (p.v, Val("any", F.col("f.v")))]))
        return unioned(parts, list(parts[0].vars), distinct=False) if len(parts) > 1 and parts[0].vars else parts[0] if len(parts) == 1 else self.union_of_none(parts)

    @staticmethod
    def union_of_none(parts: list[Bindings]) -> Bindings:
        """Without variables, only the number of rows counts."""
        df = parts[0].df.select(F.lit(True).alias("c"))
        for p in parts[1:]:
            df = df.unionAll(p.df.select(F.lit(True).alias("c")))
        return Bindings(df.select(F.col("c").alias(f"c{next(_fresh)}")), {})

    def invoked(self, x: Invoke) -> Bindings:
        found = self.derived(x)
        if found is None:
            raise ParseError(f"unknown rule {x.name}/{len(x.args)}")
        found, cond, seen = found.renamed(), F.lit(True), {}
        for t, (n, _) in zip(x.args, found.vars.items(), strict=False):
            v = found.val(n)
            if isinstance(t, Const):
                cond = cond & (self.is_const(v, t.value) if not isinstance(t.value, Keyword) else key(v) == key(literal(t.value)))
            elif isinstance(t, Var) and t.name in seen:
                cond = cond & same(seen[t.name], v)
            elif isinstance(t, Var):
                seen[t.name] = v
        out = {t.name: found.vars[n] for t, n in zip(x.args, found.vars, strict=False) if isinstance(t, Var)}
        return Bindings(found.df.where(cond), out)

    # conjunctions

    def scans(self, clauses: list, ors: tuple[Or, ...] = ()) -> list[tuple[set[str], int, Callable[[], Bindings]]]:
        """(variables, constants, scan) of patterns and invocations; stars merged, pseudo-attributes with their pattern."""
        out, stars, owner = [], {}, {}
        groups: list[tuple[Pattern, list[Pattern]]] = []
        for c in clauses:
            if isinstance(c, Invoke):
                out.append(({t.name for t in c.args if isinstance(t, Var)}, sum(isinstance(t, Const) for t in c.args), lambda c=c: self.invoked(c)))
            elif isinstance(c.a, Const) and c.a.value.name in PSEUDO:
                if c.a.value.name == ":db/valid-at":
                    out.append((binds((c,)) - ({c.e.name} if isinstance(c.e, Var) else set()), 3, lambda c=c: self.moment(c)))
                    continue
                if self.valid_at != "any":
                    raise ParseError(f"{c.a.value.name} needs :any-valid-time")
                if c.e not in owner:
                    groups.append((Pattern(c.e, None, None), []))
                    owner[c.e] = groups[-1][1]
                owner[c.e].append(c)
            elif self.relation(c):
                stars.setdefault((c.e if c.e is not None else object(), self.relation(c)[0].name), []).append(c)
            else:
                groups.append((c, []))
                owner[c.e] = groups[-1][1]
        for ps in stars.values():
            out.append((binds(tuple(ps)), sum(isinstance(t, Const) for p in ps for t in (p.e, p.v)), lambda ps=ps: self.star(ps, ors)))
        # patterns on one entity: the log is dealt by entity before the snapshot, which the join then needn't do again
        meets = Counter(p.e.name for p, _ in groups if isinstance(p.e, Var))
        for p, pseudo in groups:
            known = {t for e, t in stars if e == p.e and isinstance(e, Var)}
            if not isinstance(p.a, Const) and self.relations:
                scan = lambda p=p, q=pseudo, known=known: self.everywhere(p, q, known or None)
            else:
                scan = lambda p=p, q=pseudo: self.log_scan(p, q, isinstance(p.e, Var) and meets[p.e.name] > 1)
            out.append((binds((p, *pseudo)), 2 * isinstance(p.e, Const) + isinstance(p.v, Const), scan))
        return out

    def moment(self, p: Pattern) -> Bindings:
        """:db/valid-at is one value for the whole query: nil under any-valid-time."""
        v = literal(None if self.valid_at == "any" else self.valid_at)
        name = f"c{next(_fresh)}"
        one = self.spark.range(1)
        if isinstance(p.v, Const):
            return Bindings(one.where(matches(v, p.v.value)).select(F.lit(True).alias(name)), {})
        return Bindings(one.select(v.col.alias(name)), {p.v.name: (name, v.kind)} if isinstance(p.v, Var) else {})

    def conjunction(self, clauses: tuple, start: Bindings | None = None) -> Bindings:
        """Scans in an order that keeps them connected, expressions as soon as they can, then or, then not."""
        at = start
        asked = self.filters(clauses) if start is None else []
        todo = self.scans([c for c in clauses if isinstance(c, (Pattern, Invoke))], tuple(asked))
        exprs, ors, nots = ([c for c in clauses if isinstance(c, k) and c not in asked] for k in (Expr, Or, Not))

        def settle() -> None:
            nonlocal at
            again = True
            while again:
                again = False
                for e in list(exprs):
                    if call_vars(e.call) <= set(at.vars if at else ()):
                        exprs.remove(e)
                        at, again = self.expression(e, at), True

        settle_empty = at is None and not todo and not ors
        if settle_empty:
            at = Bindings(self.spark.range(1).select(F.lit(True).alias(f"c{next(_fresh)}")), {})
        if at is not None:
            settle()
        while todo:
            bound = set(at.vars) if at else set()
            best = max(todo, key=lambda s: (bool(s[0] & bound), s[1], -len(s[0] - bound)))
            todo.remove(best)
            at = best[2]() if at is None else joined(at, best[2]())
            settle()
        while ors:
            nxt = next((o for o in ors if o.join is None), ors[0])
            ors.remove(nxt)
            at = self.disjunction(nxt, at)
            settle()
        if exprs:
            at = at.where(F.lit(False))
        for n in nots:
            at = self.negation(n, at)
        return at

    def expression(self, e: Expr, at: Bindings | None) -> Bindings:
        if at is None:
            at = Bindings(self.spark.range(1).select(F.lit(True).alias(f"c{next(_fresh)}")), {})
        v, ok = compile_expr(e.call, at.vals(), self.predicates)
        if e.out is None:
            return at.where(truthy(v, ok))
        if e.out.name in at.vars:
            return at.where(F.coalesce(ok & same(at.val(e.out.name), v), F.lit(False)))
        name = f"c{next(_fresh)}"
        out = {**at.vars, e.out.name: (name, v.kind)}
        return Bindings(at.df.where(F.coalesce(ok, F.lit(False))).select("*", v.col.alias(name)), out)

    def standalone(self, body: tuple) -> bool:
        """Whether the body can be evaluated without outer bindings."""
        scans = tuple(c for c in body if isinstance(c, (Pattern, Invoke)))
        if not scans and not any(isinstance(c, Or) for c in body):
            return False
        own = binds(body)
        for c in body:
            if isinstance(c, Expr) and not call_vars(c.call) <= own:
                return False
            if isinstance(c, Not) and not ({v.name for v in c.join} if c.join else mentions(c.body)) <= own:
                return False
            if isinstance(c, Or) and not all(self.standalone(b) for b in c.branches):
                return False
        return True

    def disjunction(self, o: Or, at: Bindings | None) -> Bindings:
        outer = set(at.vars) if at else set()
        if o.join is not None:
            names = [v.name for v in o.join]
            parts = []
            for b in o.branches:
                own = self.standalone(b) and set(names) <= binds(b)
                parts.append((self.conjunction(b) if own else self.conjunction(b, at.only(names).renamed())).only(names))
            found = unioned(parts, names).renamed()
            return Bindings(at.df.join(found.df, agree(at, found, names), "left_semi"), at.vars)
        visible = sorted(set.union(*(mentions(b) for b in o.branches)) | outer) if at else None
        if at is None or (all(map(self.standalone, o.branches)) and len({frozenset(binds(b)) for b in o.branches}) == 1):
            parts = [self.conjunction(b) for b in o.branches]
            names = sorted(set.intersection(*(set(p.vars) for p in parts)))
            found = unioned(parts, names)
            if at is None:
                return found
            out = joined(at, found)
            return Bindings(out.df.distinct(), out.vars)
        parts = [self.conjunction(b, at) for b in o.branches]
        return unioned(parts, [n for n in visible if all(n in p.vars for p in parts)])

    def negation(self, n: Not, at: Bindings) -> Bindings:
        body = n.body
        scans = tuple(c for c in body if not isinstance(c, Expr))
        exprs = [c for c in body if isinstance(c, Expr)]
        if not scans:
            hit = F.lit(True)
            vals = at.vals()
            for e in exprs:
                v, ok = compile_expr(e.call, vals, self.predicates)
                if e.out is not None and e.out.name not in vals:
                    vals[e.out.name], c = v, ok
                elif e.out is not None:
                    c = ok & same(vals[e.out.name], v)
                else:
                    c = truthy(v, ok)
                hit = hit & F.coalesce(c, F.lit(False))
            return at.where(~hit)
        outer = {v.name for v in n.join} if n.join else set(at.vars)
        own = binds(body)
        late = [e for e in exprs if not call_vars(e.call) <= own] if self.standalone(scans) else exprs
        if self.standalone(scans):
            inner = self.conjunction(tuple(c for c in body if c not in late)).renamed()
        else:
            inner, late = self.conjunction(body, at.only(sorted(outer & set(at.vars))).renamed()).renamed(), []
        shared = [x for x in inner.vars if x in outer and x in at.vars]
        cond = agree(at, inner, shared)
        vals = {**inner.vals(), **{k: v for k, v in at.vals().items() if k in outer}}
        for e in late:
            v, ok = compile_expr(e.call, vals, self.predicates)
            if e.out is not None and e.out.name not in vals:
                vals[e.out.name] = v
                cond = cond & F.coalesce(ok, F.lit(False))
            else:
                cond = cond & (truthy(v, ok) if e.out is None else F.coalesce(ok & same(vals[e.out.name], v), F.lit(False)))
        return Bindings(at.df.join(inner.df, cond, "left_anti"), at.vars)
