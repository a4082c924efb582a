"""The append-only fact log, and what of it is true at a moment.

Facts are rows of ``FACTS``. A file log is a folder: ``data-<n>`` holds Parquet files partitioned by attribute, one append
for each commit, and is replaced by the next generation when the log is compacted; ``_tx`` holds an empty file for each
transaction of the current generation, named by its counter and time, so opening a log reads names only. A transaction
takes its counter before it writes its facts, so no counter is given twice. One writer at a time: the second one to take
a counter fails.
"""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.functions.values import BOOL, FLT, INT, KW, NULL, REF, STR, TAGGED, entity_id
from kairolog.plans.edn import Keyword

FACTS = f"e string, a string, v {TAGGED}, tx_id bigint, tx_count bigint, valid_from bigint, valid_to bigint, asserted boolean"
#: Facts on the driver before they are written to the folder, or for a log in memory, made one DataFrame.
Row = tuple[str, str, tuple, int, int, int, int, bool]


def tagged(x: Any) -> tuple:
    if x is None:
        return (NULL, None, None, None, None)
    if isinstance(x, bool):
        return (BOOL, None, None, None, x)
    if isinstance(x, int):
        return (INT, None, x, None, None)
    if isinstance(x, float):
        return (FLT, None, None, x, None)
    if isinstance(x, uuid.UUID):
        return (REF, str(x), None, None, None)
    if isinstance(x, Keyword):
        return (KW, x.name, None, None, None)
    return (STR, x, None, None, None)


class Folder:
    """Names below a folder, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        place = self._place(f"{self.path}/{below}" if below else self.path)
        return sorted(x.getPath().getName() for x in self._files.listStatus(place)) if self._files.exists(place) else []

    def mark(self, name: str) -> bool:
        """Make an empty file; False if it is there."""
        return self._files.createNewFile(self._place(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self._files.delete(self._place(f"{self.path}/{name}"), True)


def counter_name(count: int, tx_id: int) -> str:
    return f"{count:019d}-{tx_id:019d}"


class FactLog:
    def __init__(self, spark: SparkSession, path: str | None = None, base: DataFrame | None = None, compact_every: int = 1000) -> None:
        self.spark, self.base, self.compact_every = spark, base, compact_every
        self.folder = Folder(spark, path) if path else None
        self.rows: list[Row] = []
        self.last = self.newest = 0
        if base is not None:
            self._seen(base)
        if self.folder:
            self.refresh()

    def _seen(self, facts: DataFrame) -> None:
        most = facts.agg(F.max("tx_count"), F.max("tx_id")).first()
        self.last, self.newest = max(self.last, most[0] or 0), max(self.newest, most[1] or 0)

    def refresh(self) -> None:
        """Take in what others, such as streams, have appended to the folder."""
        taken = self.folder.names("_tx")
        for name in taken[-1:]:
            count, tx_id = map(int, name.split("-"))
            self.last, self.newest = max(self.last, count), max(self.newest, tx_id)
        self.commits = len(taken)

    def generation(self) -> int:
        """The newest generation that was written whole."""
        names = self.folder.names()
        return max((int(n[5:]) for n in names if n.startswith("data-") and (n == "data-0" or f"_whole-{n[5:]}" in names)), default=0)

    def data(self) -> str:
        return f"{self.folder.path}/data-{self.generation()}"

    def _stored(self) -> DataFrame | None:
        if not self.folder or f"data-{self.generation()}" not in self.folder.names():
            return None
        return self.spark.read.schema(FACTS).parquet(self.data()).select("e", "a", "v", "tx_id", "tx_count", "valid_from", "valid_to", "asserted")

    def facts(self, pending: list[Row] = []) -> DataFrame:  # noqa: B006
        parts = [x for x in (self.base, self._stored()) if x is not None]
        if self.rows or pending or not parts:
            parts.append(self.spark.createDataFrame([*self.rows, *pending], FACTS))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def stamp(self, facts: list[tuple], asserted: bool, tx_id: int, tx_count: int) -> list[Row]:
        return [(entity_id(e), a, tagged(v), tx_id, tx_count, tx_id if vf is None else vf, vt, asserted) for e, a, v, vf, vt in facts]

    def take(self) -> tuple[int, int]:
        """The next transaction's (tx_count, tx_id)."""
        count, tx_id = self.last + 1, max(int(time.time() * 1000), self.newest)
        if self.folder:
            if not self.folder.mark(f"_tx/{counter_name(count, tx_id)}") or sum(n.startswith(f"{count:019d}-") for n in self.folder.names("_tx")[-2:]) > 1:
                raise RuntimeError(f"another writer took transaction {count}")
            self.commits += 1
        self.last, self.newest = count, tx_id
        return count, tx_id

    def commit(self, writes: list[tuple[list[tuple], bool]]) -> int:
        """One transaction of (facts, asserted) writes; its tx_id."""
        count, tx_id = self.take()
        rows = [r for facts, asserted in writes for r in self.stamp(facts, asserted, tx_id, count)]
        if self.folder:
            self.append(self.spark.createDataFrame(rows, FACTS))
            if self.commits >= self.compact_every:
                self.compact()
        else:
            self.rows += rows
        return tx_id

    def append(self, rows: DataFrame) -> None:
        rows.write.partitionBy("a").mode("append").parquet(self.data())

    def load(self, facts: DataFrame) -> None:
        """Take in facts with their transaction columns, once each. In a folder they are appended without passing the driver."""
        keys = ["e", "a", "v", "valid_from", "valid_to", "tx_count", "asserted"]
        facts = facts.dropDuplicates(keys)
        if not self.folder:
            self.base = facts if self.base is None else self.base.unionByName(facts).dropDuplicates(keys)
            self._seen(facts)
            return
        stored = self._stored()
        if stored is not None:
            same = F.lit(True)
            for k in keys:
                same = same & facts[k].eqNullSafe(stored[k])
            facts = facts.join(stored, same, "left_anti")
        self._seen(facts)
        self.folder.mark(f"_tx/{counter_name(self.last, self.newest)}")
        self.append(facts)

    def compact(self) -> None:
        """Write the next generation, dealt and sorted by ranges of (a, e) so that row groups can be skipped by entity; then drop the old one."""
        old, stored = self.generation(), self._stored()
        if stored is None:
            return
        new = old + 1
        self.folder.delete(f"data-{new}")  # of a compaction that didn't end
        stored.repartitionByRange("a", "e").sortWithinPartitions("a", "e").write.partitionBy("a").parquet(f"{self.folder.path}/data-{new}")
        self.folder.mark(f"_whole-{new}")
        self.folder.delete(f"data-{old}")
        self.folder.delete(f"_whole-{old}")
        for name in self.folder.names("_tx")[:-1]:
            self.folder.delete(f"_tx/{name}")
        self.commits = 1


def snapshot(facts: DataFrame, as_of: tuple[str, int] | None, valid_at: int | str, by_entity: bool = False) -> DataFrame:
    """Transaction filter, net assertions, valid time, in this order. One shuffle, on (e, a, v), or on e for joins there, and one sort."""
    if as_of is not None:
        facts = facts.where(F.col("tx_count" if as_of[0] == "count" else "tx_id") <= as_of[1])
    if by_entity:
        facts = facts.repartition("e")
    # the newest assertion of each interval and the newest retraction; older ones decide nothing
    newest = Window.partitionBy("e", "a", "v", "asserted", F.when(F.col("asserted"), F.struct("valid_from", "valid_to"))).orderBy(F.desc("tx_count"), F.desc("tx_id"))
    out = facts.withColumn("__n", F.row_number().over(newest)).where("__n = 1")
    out = out.withColumn("__gone", F.max(F.when(~F.col("asserted"), F.col("tx_count"))).over(Window.partitionBy("e", "a", "v")))
    out = out.where("asserted AND (__gone IS NULL OR tx_count > __gone)").drop("__gone", "__n", "asserted")
    return out if valid_at == "any" else out.where((F.col("valid_from") <= valid_at) & (F.col("valid_to") > valid_at))
