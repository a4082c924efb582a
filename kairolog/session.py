"""The engine: commands in, DataFrames out."""

import re
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.functions.exprs import Predicates
from kairolog.functions.values import Val, plain
from kairolog.operators.compile import Compiler
from kairolog.operators.project import Fold, project, value
from kairolog.operators.rules import Evaluator, Registry, invocations
from kairolog.plans import parse
from kairolog.plans.edn import Keyword, ParseError, read_all
from kairolog.plans.parse import Call, Const, Query, Retract, Rule, Slot, Transact, millis
from kairolog.sources.log import FactLog, snapshot
from kairolog.sources.relations import Relation
from kairolog.sources.shared import ship


@dataclass(frozen=True)
class Entity:
    """A binding of a slot in entity position."""

    value: Keyword | uuid.UUID | int


class TxCount(int):
    pass


ANY_VALID_TIME = "any"


@dataclass(frozen=True)
class Result:
    df: DataFrame
    kinds: list[str]

    def to_df(self, aliases: Sequence[str] | None = None) -> DataFrame:
        return self.df.toDF(*aliases) if aliases else self.df

    def rows(self) -> list[tuple]:
        return [tuple(plain(x, k) for x, k in zip(r, self.kinds, strict=True)) for r in self.df.collect()]

    def text(self) -> str:
        """Tab-separated, as a reader of the notation would write it."""
        def show(x: Any) -> str:
            if isinstance(x, str):
                return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
            if isinstance(x, uuid.UUID):
                return f'#uuid "{x}"'
            return {True: "true", False: "false"}[x] if isinstance(x, bool) else "nil" if x is None else str(x)

        return "\n".join("\t".join(line) for line in [self.df.columns, *([show(x) for x in r] for r in self.rows())])


def slots(x: Any) -> set[str]:
    if isinstance(x, Slot):
        return {x.name}
    if is_dataclass(x):
        return set().union(*(slots(getattr(x, f.name)) for f in fields(x)))
    return set().union(*map(slots, x)) if isinstance(x, tuple) and x else set()


def fill(x: Any, values: Mapping[str, Any], entity: bool = False) -> Any:
    """The tree with slots replaced."""
    if isinstance(x, Slot):
        v = values[x.name]
        if isinstance(v, Entity) != entity or isinstance(v, TxCount):
            raise TypeError(f"slot {x.name} has the wrong kind of value")
        return Const(v.value if entity else v)
    if isinstance(x, parse.Pattern):
        return parse.Pattern(fill(x.e, values, True), x.a, fill(x.v, values))
    if isinstance(x, tuple):
        return tuple(fill(y, values) for y in x)
    if is_dataclass(x) and not isinstance(x, (Keyword, Const)):
        return replace(x, **{f.name: fill(getattr(x, f.name), values) for f in fields(x) if f.name != "limits"})
    return x


class Prepared:
    def __init__(self, db: "Database", query: Query) -> None:
        self.db, self.query, self.names = db, query, slots(query)
        if any(isinstance(c, Call) and c.fn == "matches?" and slots(c) for c in _calls(query)):
            raise ParseError("a slot cannot stand in matches?")

    def execute(self, values: Mapping[str, Any]) -> Result:
        if missing := self.names - set(values):
            raise KeyError(f"missing slots: {sorted(missing)}")
        q = self.query
        if isinstance(q.as_of, Slot):
            v = values[q.as_of.name]
            if not isinstance(v, (TxCount, str)):
                raise TypeError(":as-of takes a TxCount or a timestamp")
            q = replace(q, as_of=("count", int(v)) if isinstance(v, TxCount) else ("ms", max(0, millis(v))))
        if isinstance(q.valid_at, Slot):
            v = values[q.valid_at.name]
            q = replace(q, valid_at=v if v == ANY_VALID_TIME else millis(v))
        return self.db.run(replace(fill(replace(q, as_of=None, valid_at=None), values), as_of=q.as_of, valid_at=q.valid_at))


def _calls(x: Any) -> Iterable[Call]:
    if isinstance(x, Call):
        yield x
    if is_dataclass(x):
        for f in fields(x):
            yield from _calls(getattr(x, f.name))
    elif isinstance(x, tuple):
        for y in x:
            yield from _calls(y)


class Write:
    """Commands that become visible to others together, at commit; its own reads see them before."""

    def __init__(self, db: "Database") -> None:
        self.db, self.writes, self.open = db, [], True

    def execute(self, text: str) -> Any:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        c = parse.command(text)
        if isinstance(c, (Transact, Retract)):
            self.writes.append((list(c.facts), isinstance(c, Transact)))
            return None
        if isinstance(c, Rule):
            return self.db.registry.register(c)
        now = int(time.time() * 1000)
        log = self.db.log
        tx = max(now, log.newest)
        pending = [r for facts, asserted in self.writes for r in log.stamp(facts, asserted, tx, log.last + 1)]
        return self.db.run(c, pending, max(now, tx))

    def commit(self) -> int | None:
        self.open = False
        return self.db.log.commit(self.writes) if self.writes else None

    def rollback(self) -> None:
        self.open, self.writes = False, []

    def __enter__(self) -> "Write":
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if self.open:
            self.commit() if kind is None else self.rollback()


class Database:
    """A fact log, in memory or in a folder, and any number of tables registered as attributes. Rules derive without limit unless one is given."""

    def __init__(self, spark: SparkSession, path: str | None = None, facts: DataFrame | None = None, max_derived_facts: int | None = None, max_results: int | None = None) -> None:
        self.spark, self.log = spark, FactLog(spark, path, facts)
        self.relations: dict[str, Relation] = {}
        self.registry = Registry()
        self.predicates: dict[str, Callable] = {}
        self.aggregates: dict[str, Fold] = {}
        self.limits = {":max-derived-facts": max_derived_facts, ":max-results": max_results}

    def register(self, name: str, source: DataFrame | Callable[[], DataFrame], key: str | None = None, refs: Mapping[str, str] | None = None) -> None:
        self.relations[name] = Relation(name, source, key, refs or {})

    def register_aggregate(self, name: str, init: Callable[[], Any], step: Callable[[Any, Any], Any], finalise: Callable[[Any, int], Any], returns: str = "float") -> None:
        """``step`` returns the new state; nil is skipped. Runs in Python, a group at a time, or over a window with one running state."""
        if name in self.aggregates or name in parse.AGGREGATES | parse.WINDOWS:
            raise ValueError(f"{name} exists")

        ship(self.spark)
        python = {"float": float, "int": int, "str": str, "bool": bool}[returns]

        def fold(*columns: pd.Series) -> Any:
            state, n = init(), 0
            for x in _values(columns):
                if x is not None and x == x:
                    state, n = step(state, x), n + 1
            return finalise(state, n) if n else None

        grouped = _called(fold, python, {"float": "double", "int": "bigint", "str": "string", "bool": "boolean"}[returns])
        self.aggregates[name] = Fold(init, step, finalise, returns, grouped)

    def register_predicate(self, name: str, test: Callable[[Any], bool]) -> None:
        if name in self.predicates or name in parse.ARITHMETIC | parse.COMPARE | parse.STRINGS | parse.TYPES:
            raise ValueError(f"{name} exists")

        ship(self.spark)

        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([bool(test(x)) for x in _values(columns)], dtype=bool)

        self.predicates[name] = _called(run, pd.Series, "boolean")

    def execute(self, text: str) -> Any:
        """One command: a Result, a tx_id, or None for a rule."""
        return self._do(parse.command(text))

    def execute_script(self, text: str) -> list[Any]:
        return [self._do(parse.form(x)) for x in read_all(re.sub(r"(?m)^\s*#(?!uuid).*$", "", text)) if x != parse.List((parse.Symbol("EXIT"),))]

    def _do(self, c: Any) -> Any:
        if isinstance(c, Query):
            if slots(c):
                raise ParseError("a query with slots must be prepared")
            return self.run(c)
        if isinstance(c, Rule):
            return self.registry.register(c)
        return self.log.commit([(list(c.facts), isinstance(c, Transact))])

    def prepare(self, text: str) -> Prepared:
        c = parse.command(text)
        if not isinstance(c, Query):
            raise ParseError("only a query can be prepared")
        return Prepared(self, c)

    def begin_write(self) -> Write:
        return Write(self)

    def run(self, q: Query, pending: list = [], now: int | None = None) -> Result:  # noqa: B006
        _known(q, self.predicates)
        valid = (now or max(int(time.time() * 1000), self.log.newest)) if q.valid_at is None else q.valid_at
        made: dict[bool, DataFrame] = {}

        def facts(by_entity: bool = False) -> DataFrame:
            if by_entity not in made:
                made[by_entity] = snapshot(self.log.facts(pending), q.as_of, valid, by_entity)
            return made[by_entity]

        compiler = Compiler(self.spark, self.relations, facts, self.predicates, valid)
        if invocations(q.where):
            Evaluator(compiler, self.registry, q.where, self.log.last > 0 or bool(pending), self.limits | q.limits)
        df, kinds = project(q, compiler.conjunction(q.where), self.aggregates)
        return Result(df, kinds)


def _values(columns: Sequence[pd.Series]) -> Iterable[Any]:
    """Python values of one typed column, or of a tag and its payloads."""
    if len(columns) == 1:
        return columns[0].tolist()
    return (value(None if t is None or t != t else t, *rest) for t, *rest in zip(*columns, strict=True))


def _called(f: Callable, python: type, returns: str) -> Callable[[Val], Any]:
    """The function as a column of a value; a typed value travels as one column."""

    def one(x: pd.Series) -> Any:
        return f(x)

    def five(t: pd.Series, s: pd.Series, i: pd.Series, r: pd.Series, b: pd.Series) -> Any:
        return f(t, s, i, r, b)

    for g in (one, five):
        g.__annotations__ = {**{k: pd.Series for k in g.__annotations__ if k != "return"}, "return": python}
    typed, tagged = F.pandas_udf(one, returns), F.pandas_udf(five, returns)
    return lambda v: tagged(v.tag, *(v.part(p) for p in "sifb")) if v.kind == "any" else typed(v.col)


def _known(q: Query, predicates: Predicates) -> None:
    for c in _calls(q):
        if c.fn not in parse.ARITHMETIC | parse.COMPARE | parse.STRINGS | parse.TYPES and c.fn not in predicates:
            raise ParseError(f"unknown predicate {c.fn}")
