"""What :find asks for: projection, aggregates, cumulative windows.

A window without partitions doesn't pass through one task: rows are dealt by ranges of the order, each range runs its
own window, and the totals of the ranges before it, a row per range, are added. A Python fold has no way to add totals,
so it runs over the sorted rows of a partition with one running state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairolog.functions.values import BOOL, FLT, INT, NULL, STR, TAGGED, Val
from kairolog.operators.compile import Bindings
from kairolog.plans.parse import Agg, Over, ParseError, Query, Var
from kairolog.sources.shared import keep

MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def name(f: Any) -> str:
    if isinstance(f, Var):
        return f.name
    if isinstance(f, Agg):
        return f"({f.fn} {f.var.name})"
    return f"({f.fn}{' ' + f.var.name if f.var else ''} :over ...)"


def _clamped(total: Column) -> Column:
    return F.greatest(F.least(total, F.lit(str(MOST)).cast("decimal(38,0)")), F.lit(str(LEAST)).cast("decimal(38,0)")).cast("bigint")


def _present(v: Val) -> Column:
    return F.when(v.tag != NULL, v.col) if v.kind == "any" else v.col


def _any(t: Column, i: Column | None = None, f: Column | None = None, s: Column | None = None) -> Column:
    empty = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}
    given = {"i": i, "f": f, "s": s, "b": None}
    return F.struct(t.cast("tinyint").alias("t"), *((given[k] if given[k] is not None else F.lit(None).cast(empty[k])).alias(k) for k in "sifb"))


def aggregate(fn: str, v: Val) -> tuple[Column, str]:
    """The aggregate and its kind. Nil is skipped; an unsuitable type is an error."""
    distinct = fn.endswith("-distinct")
    base = fn.removesuffix("-distinct")
    if base == "count":
        return (F.count_distinct(_present(v)) if distinct else F.count(_present(v))), "int"
    if base == "sum":
        add = F.sum_distinct if distinct else F.sum
        if v.base == "int":
            return F.coalesce(_clamped(add(v.col.cast("decimal(20,0)")).cast("decimal(38,0)")), F.lit(0).cast("bigint")), "int"
        if v.kind == "float":
            return add(v.col), "float"
        if v.kind == "any":
            odd = F.count(F.when(~v.has(INT, FLT, NULL), 1)) > 0
            whole = F.coalesce(_clamped(add(v.part("i").cast("decimal(20,0)")).cast("decimal(38,0)")), F.lit(0).cast("bigint"))
            real = F.coalesce(add(v.part("f")), F.lit(0.0)) + whole
            floats = F.count(v.part("f")) > 0
            t = F.when(odd, F.raise_error(F.lit("sum of a value that is no number"))).when(floats, F.lit(FLT)).otherwise(F.lit(INT))
            return _any(t, F.when(~floats, whole), F.when(floats, real)), "any"
        raise TypeError(f"sum of {v.kind}")
    if base in ("min", "max"):
        pick = F.min if base == "min" else F.max
        if v.base in ("int", "float", "str"):
            return pick(v.col), v.kind
        if v.kind == "any":
            kinds = F.count_distinct(F.when(v.tag != NULL, v.tag))
            bad = (kinds > 1) | (F.count(F.when(~v.has(INT, FLT, STR, NULL), 1)) > 0)
            t = F.when(bad, F.raise_error(F.lit(f"{base} of values of several types"))).otherwise(F.max(F.when(v.tag != NULL, v.tag)))
            return F.when(kinds > 0, _any(t, pick(v.part("i")), pick(v.part("f")), pick(v.part("s")))), "any"
        raise TypeError(f"{base} of {v.kind}")
    raise ParseError(f"unknown aggregate {fn}")


@dataclass(frozen=True)
class Fold:
    """A user's aggregate: its steps, the kind of its result, and its grouped form as a column of a value."""

    init: Callable[[], Any]
    step: Callable[[Any, Any], Any]
    finalise: Callable[[Any, int], Any]
    kind: str
    grouped: Callable[[Val], Column]


def value(t: int | None, s: Any, i: Any, f: Any, b: Any) -> Any:
    """The Python value of a tag and its payloads."""
    return int(i) if t == INT else bool(b) if t == BOOL else f if t == FLT else None if t is None or t == NULL else s


def order_keys(v: Val) -> list[Column]:
    """Numbers compare as numbers, of whatever type; then strings; others are equal among themselves."""
    if v.kind != "any":
        return [v.col]
    number = v.has(INT, FLT)
    whole = F.coalesce(v.part("i"), F.when(F.abs(v.part("f")) < 9e18, v.part("f").cast("bigint")))
    return [F.when(number, 0).when(v.has(STR), 1).otherwise(2), F.when(number, v.number), F.when(number, whole), F.when(v.has(STR), v.part("s"))]


def directed(keys: list[Column], desc: bool) -> list[Column]:
    return [k.desc_nulls_last() if desc else k.asc_nulls_last() for k in keys]


def over(f: Over, vals: Mapping[str, Val], spec: Any) -> tuple[Column, str]:
    """The window function over an ordered spec, and its kind."""
    rows = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if f.fn == "row-number":
        return F.row_number().over(spec).cast("bigint"), "int"
    if f.fn == "rank":
        return F.rank().over(spec).cast("bigint"), "int"
    v = vals[f.var.name]
    if f.fn == "count":
        return F.count(_present(v)).over(rows), "int"
    if f.fn == "sum":
        if v.base == "int":
            return F.coalesce(F.sum(v.col).over(rows), F.lit(0)).cast("bigint"), "int"
        if v.kind == "any":
            real, floats = F.coalesce(F.sum(v.number).over(rows), F.lit(0.0)), F.count(v.part("f")).over(rows) > 0
            return _any(F.when(floats, F.lit(FLT)).otherwise(F.lit(INT)), F.when(~floats, real.cast("bigint")), F.when(floats, real)), "any"
        return F.coalesce(F.sum(v.number).over(rows), F.lit(0.0)), "float"
    if f.fn == "avg":
        return F.avg(v.number).over(rows), "float"
    if f.fn in ("min", "max"):
        pick, by = (F.min, F.min_by) if f.fn == "min" else (F.max, F.max_by)
        if v.kind != "any":
            return pick(v.col).over(rows), v.kind
        number = F.when(v.has(INT, FLT), v.number)
        return F.coalesce(by(F.when(number.isNotNull(), v.col), number).over(rows), pick(F.when(v.has(STR), v.col)).over(rows)), "any"
    raise ParseError(f"unknown window function {f.fn}")


def addable(f: Over, vals: Mapping[str, Val]) -> bool:
    """Whether the function's totals of two stretches can be put together."""
    return f.fn in ("row-number", "rank", "count") or vals[f.var.name].kind != "any"


def running(df: DataFrame, fs: dict[int, Over], vals: Mapping[str, Val]) -> tuple[DataFrame, dict[int, str]]:
    """The rows with a column ``w<i>`` for each function, all over one order and no partitions."""
    one = next(iter(fs.values()))
    keys = order_keys(vals[one.order.name])
    names = [f"__o{j}" for j in range(len(keys))]
    raw = directed([F.col(n) for n in names], one.desc)
    held = df.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    held = keep(held.repartitionByRange(*raw).withColumn("__part", F.spark_partition_id()))
    totals, kinds = [F.count(F.lit(1)).alias("__ahead")], {}
    for i, f in fs.items():
        v = vals[f.var.name] if f.var is not None else None
        if f.fn in ("count", "avg"):
            totals.append(F.count(_present(v)).alias(f"__n{i}"))
        if f.fn in ("sum", "avg"):
            totals.append(F.sum(v.col if v.base == "int" and f.fn == "sum" else v.number).alias(f"__s{i}"))
        if f.fn in ("min", "max"):
            totals.append((F.min if f.fn == "min" else F.max)(v.col).alias(f"__m{i}"))
    per = held.groupBy("__part").agg(*totals)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ahead = [F.col("__part").alias("__p")]
    for c in per.columns[1:]:
        add = F.sum if not c.startswith("__m") else F.min if fs[int(c[3:])].fn == "min" else F.max
        ahead.append(add(c).over(before).alias(c))
    out = held.join(F.broadcast(per.select(*ahead)), F.col("__part") == F.col("__p"))
    spec = Window.partitionBy("__part").orderBy(*raw)
    rows = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {}
    for i, f in fs.items():
        col, kinds[i] = over(f, vals, spec)
        if f.fn in ("row-number", "rank"):
            col = col + F.coalesce("__ahead", F.lit(0))
        elif f.fn == "count":
            col = col + F.coalesce(f"__n{i}", F.lit(0))
        elif f.fn == "sum":
            col = col + F.coalesce(f"__s{i}", F.lit(0))
        elif f.fn == "avg":
            v = vals[f.var.name]
            n = F.coalesce(f"__n{i}", F.lit(0)) + F.count(_present(v)).over(rows)
            col = F.when(n > 0, (F.coalesce(f"__s{i}", F.lit(0.0)) + F.coalesce(F.sum(v.number).over(rows), F.lit(0.0))) / n)
        else:
            col = (F.least if f.fn == "min" else F.greatest)(col, f"__m{i}")
        cols[f"w{i}"] = col
    return out.select(*df.columns, *(c.alias(n) for n, c in cols.items())), kinds


def folded(df: DataFrame, i: int, f: Over, fold: Fold, vals: Mapping[str, Val]) -> DataFrame:
    """The rows with ``w<i>``: one state runs over the sorted rows of each partition. All of one partition pass through a task, in batches."""
    column, kinds = f"w{i}", {"float": T.DoubleType(), "int": T.LongType(), "str": T.StringType(), "bool": T.BooleanType()}
    v, part = vals[f.var.name], [vals[f.partition.name].col] if f.partition else []
    keys = order_keys(vals[f.order.name])
    held = df.select("*", v.tagged().col.cast(TAGGED).alias("__v"), (F.struct(*part) if part else F.lit(0)).alias("__p"), *(k.alias(f"__o{j}") for j, k in enumerate(keys)))
    held = (held.repartition("__p") if part else held.repartition(1)).sortWithinPartitions("__p", *directed([F.col(f"__o{j}") for j in range(len(keys))], f.desc))
    names, target = df.columns, {"float": pa.float64(), "int": pa.int64(), "str": pa.string(), "bool": pa.bool_()}[fold.kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n, done = None, None, 0, False
        for batch in batches:
            out = []
            for p, x in zip(batch.column("__p").to_pylist(), batch.column("__v").to_pylist(), strict=True):
                if not done or p != at:
                    at, state, n, done = p, fold.init(), 0, True
                if x is not None and x["t"] != NULL and (got := value(*(x[k] for k in "tsifb"))) is not None:
                    state, n = fold.step(state, got), n + 1
                out.append(fold.finalise(state, n) if n else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, target)], [*names, column])

    return held.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, kinds[fold.kind])]))


def project(q: Query, b: Bindings, functions: Mapping[str, Any]) -> tuple[DataFrame, list[str]]:
    """The result and its columns' kinds."""
    aggs, overs = [f for f in q.find if isinstance(f, Agg)], [f for f in q.find if isinstance(f, Over)]
    for f in (*aggs, *overs):
        known = ("count", "count-distinct", "sum", "sum-distinct", "min", "max") if isinstance(f, Agg) else ("row-number", "rank", "count", "sum", "min", "max", "avg")
        if f.fn not in known and f.fn not in functions:
            raise ParseError(f"unknown aggregate {f.fn}")
    vals = b.vals()
    unbound = [f.name for f in q.find if isinstance(f, Var) and f.name not in vals]
    if unbound:
        return b.df.limit(0).select(*(F.lit(None).cast("string").alias(name(f)) for f in q.find)), ["str"] * len(q.find)
    out: dict[int, tuple[Column, str]] = {}
    df = b.df
    if aggs:
        keys = list(dict.fromkeys([f.name for f in q.find if isinstance(f, Var)] + ([v.name for v in q.with_] if not overs else [])))
        grouped = df.select(*(vals[k].col.alias(f"k{j}") for j, k in enumerate(keys)), *(c for c, _ in b.vars.values()))
        names = [f"k{j}" for j in range(len(keys))]
        own = {i: functions[f.fn].grouped(vals[f.var.name]).alias(f"a{i}") for i, f in enumerate(q.find) if isinstance(f, Agg) and f.fn in functions}
        cols = {i: (None, functions[f.fn].kind) if i in own else aggregate(f.fn, vals[f.var.name]) for i, f in enumerate(q.find) if isinstance(f, Agg)}
        df = grouped.groupBy(*names).agg(*(c.alias(f"a{i}") for i, (c, _) in cols.items() if i not in own), F.count(F.lit(1)).alias("__rows"))
        if own:  # Python aggregates run apart from the others
            more = grouped.groupBy(*names).agg(*own.values())
            if names:
                more = more.select(*(F.col(n).alias(f"__{n}") for n in names), *(f"a{i}" for i in own))
                cond = F.lit(True)
                for n in names:
                    cond = cond & F.col(n).eqNullSafe(F.col(f"__{n}"))
                df = df.join(more, cond)
            else:
                df = df.crossJoin(more)  # one row each
        if not keys and not all(f.fn.startswith("count") for f in q.find):
            df = df.where("__rows > 0")
        vals = {k: Val(vals[k].kind, F.col(f"k{j}")) for j, k in enumerate(keys)}
        for i, f in enumerate(q.find):
            if isinstance(f, Agg):
                out[i] = F.col(f"a{i}"), cols[i][1]
                if f.fn in ("min", "max"):
                    df = df.where(F.col(f"a{i}").isNotNull())
        for f in overs:  # what is not in the key is nil over collapsed rows
            for v in (f.var, f.partition, f.order):
                if v is not None and v.name not in vals:
                    vals[v.name] = Val("int", F.lit(None).cast("bigint"))
    whole: dict[tuple[str, bool], dict[int, Over]] = {}
    for i, f in enumerate(q.find):
        if isinstance(f, Var):
            out[i] = vals[f.name].col, vals[f.name].kind
        elif isinstance(f, Over) and f.fn in functions:
            df = folded(df, i, f, functions[f.fn], vals)
            out[i] = F.col(f"w{i}"), functions[f.fn].kind
        elif isinstance(f, Over) and (f.partition or not addable(f, vals)):
            spec = Window.partitionBy(*([vals[f.partition.name].col] if f.partition else [])).orderBy(*directed(order_keys(vals[f.order.name]), f.desc))
            out[i] = over(f, vals, spec)
        elif isinstance(f, Over):
            whole.setdefault((f.order.name, f.desc), {})[i] = f
    for fs in whole.values():
        df, kinds = running(df, fs, vals)
        out |= {i: (F.col(f"w{i}"), kinds[i]) for i in fs}
    names = [name(f) for f in q.find]
    unique = [n if names.index(n) == i else f"{n}#{names[:i].count(n) + 1}" for i, n in enumerate(names)]
    return df.select(*(out[i][0].alias(n) for i, n in enumerate(unique))), [out[i][1] for i in range(len(names))]
