"""Expressions to columns: a value, and whether it has one. Any error drops the row."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairolog.functions.values import BOOL, FLT, INT, NULL, STR, Val, literal
from kairolog.plans.parse import ARITHMETIC, COMPARE, STRINGS, TYPES, Call, Const, ParseError, Var

_TAG_OF = {"string?": STR, "integer?": INT, "float?": FLT, "boolean?": BOOL, "nil?": NULL}
Predicates = Mapping[str, Callable[[Any], Any]]


def _wrapped(op: str, a: Column, b: Column) -> Column:
    """Two's complement, through wide decimals; only reached on overflow."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    half, full = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    x = {"+": a + b, "-": a - b, "*": a * b}[op].cast("decimal(38,0)")
    return (F.pmod(F.pmod(x, full) + half, full) - half).cast("bigint")


def _integer(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        safe = F.nullif(b, F.lit(0).cast("bigint"))
        return F.when(b == -1, _wrapped("-", F.lit(0), a)).otherwise(_quotient(a, safe))
    fast = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    return F.coalesce(fast, _wrapped(op, a, b))


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", F.when(b == -1, F.lit(0).cast("bigint")).otherwise(a), b)


def _float(op: str, a: Column, b: Column) -> Column:
    x = {"+": a + b, "-": a - b, "*": a * b, "/": a / F.nullif(b, F.lit(0.0))}[op]
    return F.when(~F.isnan(x), x)


def arithmetic(op: str, a: Val, b: Val) -> tuple[Val, Column]:
    if a.base == b.base == "int":
        x = _integer(op, a.col, b.col)
        return Val("int", x), x.isNotNull()
    if {a.base, b.base} <= {"int", "float"}:
        x = _float(op, a.number, b.number)
        return Val("float", x), x.isNotNull()
    numbers = a.has(INT, FLT) & b.has(INT, FLT)
    whole = a.has(INT) & b.has(INT)
    i, f = F.when(whole, _integer(op, a.part("i"), b.part("i"))), F.when(numbers & ~whole, _float(op, a.number, b.number))
    t = F.when(whole, F.lit(INT)).otherwise(F.lit(FLT)).cast("tinyint")
    out = F.struct(t.alias("t"), F.lit(None).cast("string").alias("s"), i.alias("i"), f.alias("f"), F.lit(None).cast("boolean").alias("b"))
    return Val("any", out), numbers & (i.isNotNull() | f.isNotNull())


def _order(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def compare(op: str, a: Val, b: Val) -> tuple[Val, Column]:
    if a.base == b.base and a.base in ("int", "str"):
        return Val("bool", _order(op, a.col, b.col)), F.lit(True)
    if {a.base, b.base} <= {"int", "float"}:
        x, y = a.number, b.number
        return Val("bool", ~F.isnan(x) & ~F.isnan(y) & _order(op, x, y)), F.lit(True)
    numbers, strings = a.has(INT, FLT) & b.has(INT, FLT), a.has(STR) & b.has(STR)
    x, y = a.number, b.number
    out = F.when(numbers, ~F.isnan(x) & ~F.isnan(y) & _order(op, x, y)).when(strings, _order(op, a.part("s"), b.part("s")))
    return Val("bool", out), numbers | strings


def equal(a: Val, b: Val) -> Column:
    if a.kind != "any" and b.kind != "any":
        if a.base != b.base or (a.table and b.table and a.table != b.table):
            return F.lit(False)
        return (a.col == b.col) & ~F.isnan(a.col) if a.base == "float" else a.col == b.col
    same = (a.part("s").eqNullSafe(b.part("s"))) & (a.part("i").eqNullSafe(b.part("i"))) & (a.part("b").eqNullSafe(b.part("b"))) & (a.part("f").eqNullSafe(b.part("f")))
    return (a.tag == b.tag) & same & ~F.coalesce(F.isnan(a.part("f")), F.lit(False))


def compile_expr(x: Any, bound: Mapping[str, Val], predicates: Predicates) -> tuple[Val, Column]:
    """The value, and a condition under which it exists."""
    if isinstance(x, Var):
        if x.name not in bound:
            return Val("bool", F.lit(False)), F.lit(False)
        return bound[x.name], F.lit(True)
    if isinstance(x, Const):
        return literal(x.value), F.lit(True)
    if not isinstance(x, Call):
        raise ParseError(f"unbound slot {x}")
    parts = [compile_expr(a, bound, predicates) for a in x.args]
    ok = F.lit(True)
    for _, c in parts:
        ok = ok & c
    vals = [v for v, _ in parts]
    if x.fn in ARITHMETIC:
        v, c = arithmetic(x.fn, *vals)
    elif x.fn in ("=", "!="):
        e = equal(*vals)
        v, c = Val("bool", e if x.fn == "=" else ~e), F.lit(True)
    elif x.fn in COMPARE:
        v, c = compare(x.fn, *vals)
    elif x.fn in STRINGS:
        a, b = (w.part("s") for w in vals)
        done = {"starts-with?": a.startswith, "ends-with?": a.endswith, "contains?": a.contains}.get(x.fn)
        v, c = Val("bool", done(b) if done else a.rlike(x.args[1].value)), vals[0].has(STR) & vals[1].has(STR)
    elif x.fn in TYPES:
        v, c = Val("bool", vals[0].has(_TAG_OF[x.fn])), F.lit(True)
    elif x.fn in predicates:
        v, c = Val("bool", predicates[x.fn](vals[0])), F.lit(True)
    else:
        raise ParseError(f"unknown predicate {x.fn}")
    return v, ok & c


def truthy(v: Val, ok: Column) -> Column:
    if v.base == "bool":
        x = v.col
    elif v.base in ("int", "float"):
        x = v.col != 0
    elif v.kind == "any":
        x = F.when(v.tag == BOOL, v.part("b")).when(v.tag == INT, v.part("i") != 0).when(v.tag == FLT, v.part("f") != 0)
    else:
        return F.lit(False)
    return F.coalesce(ok & x, F.lit(False))
