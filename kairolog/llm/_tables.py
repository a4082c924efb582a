"""Where intermediate tables live: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.sources.shared import folder
from kairolog.sources.shared import ship as ship


class Scratch:
    """The intermediate tables of one run, in a folder of their own below ``spark.checkpoint.dir``.

    Tables that nothing reads any more go at once (``drop``); those behind a lazy result go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage is cut and lost executors cost nothing."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables, or all."""
        for path in [f"{self.path}/{n}" for n in names] or [self.path]:
            with contextlib.suppress(Exception):  # a table that stays costs room only, and at the end the JVM may be gone
                self._files.delete(self._place(path), True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """One table of its own."""
    return Scratch(df.sparkSession, name).write(df, "rows")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


PLAIN = ("doc_id", "text", "n_chars")


def passing(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` over documents whose further columns stand aside in one struct, so that no name of theirs meets one of its own."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        own = [c for c in docs.columns if c in PLAIN]
        aside = [c for c in docs.columns if c not in PLAIN]
        held = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(aside)))
        out = f(docs.select(*own, held.alias("aside")), *args, **options)
        return out.select(*(F.col(c) if c in own else F.col(f"aside.c{aside.index(c)}").alias(c) for c in docs.columns))

    return run


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
