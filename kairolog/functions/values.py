"""Values as columns. A variable's column has a kind; ``any`` is a tagged struct, for attributes of several types."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairolog.plans.edn import Keyword

#: Tags, in the order that values of different types sort in.
STR, INT, FLT, BOOL, REF, KW, NULL = range(7)
TAGS = {"str": STR, "int": INT, "float": FLT, "bool": BOOL, "ref": REF, "kw": KW}
TAGGED = "struct<t:tinyint,s:string,i:bigint,f:double,b:boolean>"
FIELD = {"str": "s", "int": "i", "float": "f", "bool": "b", "ref": "s", "kw": "s"}
TYPE = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}


def entity_id(x: Keyword | uuid.UUID) -> str:
    if isinstance(x, uuid.UUID):
        return str(x)
    try:
        return str(uuid.UUID(x.name.lstrip(":")))
    except ValueError:
        return str(uuid.uuid5(uuid.NAMESPACE_OID, x.name))


def keyword_id(c: Column) -> Column:
    """The entity of a keyword column, as ``entity_id`` has it for keywords that are no UUID themselves."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_OID.hex)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    bare = F.lower(F.regexp_replace(c, "^:+", ""))
    return F.when(bare.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), bare).otherwise(made)


@dataclass(frozen=True)
class Val:
    kind: str  # str int float bool ref kw any, or ent:<relation>
    col: Column

    def part(self, name: str) -> Column:
        if self.kind == "any":
            return self.col[name]
        return self.col if FIELD.get(self.base) == name else F.lit(None).cast(TYPE[name])

    @property
    def base(self) -> str:
        return "int" if self.kind.startswith("ent:") else self.kind

    @property
    def tag(self) -> Column:
        return self.col["t"] if self.kind == "any" else F.lit(TAGS[self.base])

    def has(self, *tags: int) -> Column:
        return self.tag.isin(*tags) if self.kind == "any" else F.lit(TAGS[self.base] in tags)

    @property
    def number(self) -> Column:
        return F.coalesce(self.part("f"), self.part("i").cast("double"))

    @property
    def table(self) -> str:
        """Of the entities of a table, its name."""
        return self.kind[4:] if self.kind.startswith("ent:") else ""

    def tagged(self) -> Val:
        if self.kind == "any":
            return self
        if self.table:  # entities of two tables, and numbers, stay apart
            name = F.concat(F.lit(self.table + "/"), self.col.cast("string"))
            return Val("any", F.struct(F.lit(REF).cast("tinyint").alias("t"), name.alias("s"), *(F.lit(None).cast(TYPE[f]).alias(f) for f in "ifb")))
        return Val("any", F.struct(self.tag.cast("tinyint").alias("t"), *(self.part(f).alias(f) for f in "sifb")))


def key(v: Val) -> Column:
    """What joins compare: keywords count as the entities they name, other types never meet."""
    if v.kind != "any":
        text = keyword_id(v.col) if v.kind == "kw" else v.col.cast("string")
        return F.concat(F.lit("R" if v.kind in ("ref", "kw") else f"R{v.table}/" if v.table else "SIFB"[TAGS[v.base]]), text)
    c = v.col
    return (
        F.when(c["t"] == KW, F.concat(F.lit("R"), keyword_id(c["s"]))).when(c["t"] == REF, F.concat(F.lit("R"), c["s"])).when(c["t"] == STR, F.concat(F.lit("S"), c["s"]))
        .when(c["t"] == INT, F.concat(F.lit("I"), c["i"].cast("string"))).when(c["t"] == FLT, F.concat(F.lit("F"), c["f"].cast("string"))).when(c["t"] == BOOL, F.concat(F.lit("B"), c["b"].cast("string"))).otherwise(F.lit("N"))
    )


def same(a: Val, b: Val) -> Column:
    """Whether two bound values of one variable agree: entities only with those of their own table."""
    if a.kind == b.kind and a.kind not in ("any", "kw"):
        return a.col == b.col
    if "any" in (a.kind, b.kind) or {a.kind, b.kind} <= {"kw", "ref"}:
        return key(a) == key(b)
    return F.lit(False)


def literal(x: Any) -> Val:
    if isinstance(x, bool):
        return Val("bool", F.lit(x))
    if isinstance(x, int):
        return Val("int", F.lit(x).cast("bigint"))
    if isinstance(x, float):
        return Val("float", F.lit(x))
    if isinstance(x, uuid.UUID):
        return Val("ref", F.lit(str(x)))
    if isinstance(x, Keyword):
        return Val("kw", F.lit(x.name))
    if x is None:
        return Val("any", F.struct(F.lit(NULL).cast("tinyint").alias("t"), *(F.lit(None).cast(TYPE[f]).alias(f) for f in "sifb")))
    return Val("str", F.lit(x))


def matches(v: Val, x: Any) -> Column:
    """A constant in value position: floats within epsilon, keywords and entities as one another."""
    if x is None:
        return v.has(NULL)
    if isinstance(x, float) and not isinstance(x, bool):
        return v.has(FLT) & (F.abs(v.part("f") - x) < 2.220446049250313e-16)
    if isinstance(x, (Keyword, uuid.UUID)):
        named = v.part("s") == (x.name if isinstance(x, Keyword) else str(x))
        own = KW if isinstance(x, Keyword) else REF
        if v.kind != "any":
            return named if TAGS[v.base] == own else (v.col == entity_id(x)) if v.kind == "ref" else (keyword_id(v.col) == str(x)) if v.kind == "kw" else F.lit(False)
        other = (v.tag == REF) & (v.part("s") == entity_id(x)) if own == KW else (v.tag == KW) & (keyword_id(v.part("s")) == str(x))
        return ((v.tag == own) & named) | other
    lit = literal(x)
    return v.has(TAGS[lit.kind]) & (v.part(FIELD[lit.kind]) == lit.col) if v.kind == "any" or v.base == lit.kind else F.lit(False)


def plain(row_value: Any, kind: str) -> Any:
    """A Python value of a collected one; an entity of a table among values of several kinds is ``table/number``."""
    if row_value is None:
        return None
    if kind != "any":
        return Keyword(row_value) if kind == "kw" else uuid.UUID(row_value) if kind == "ref" else row_value
    t = row_value["t"]
    x = row_value["s" if t in (STR, REF, KW) else "i" if t == INT else "f" if t == FLT else "b"] if t != NULL else None
    return Keyword(x) if t == KW else uuid.UUID(x) if t == REF and "/" not in x else x
