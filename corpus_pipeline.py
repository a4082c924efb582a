"""A corpus pipeline of five operators, each stage written and read again by the caller.

Quality rules, line dedup, n-gram Jaccard join (one document of each group stays), benchmark decontamination, packing.
All but the last return the columns of ``documents``. Documents that line dedup leaves without words go with the join:
what they held stands elsewhere, line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.llm._tables import Scratch, load
from kairolog.llm.decontamination import decontaminated
from kairolog.llm.line_dedup import run_dedup
from kairolog.llm.ngram_join import one_of_each
from kairolog.llm.packing import pack
from kairolog.llm.quality import clean
from kairolog.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return run_dedup(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", join_ngrams), ("benchmark decontamination", decontaminate), ("packing", packing)]

#: Tokenizing and chosen paths have no SQL; ``tests/llm/test_pipeline.py`` holds every row against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark, "pipeline"), load(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        table = name.replace(" ", "-")
        docs = scratch.write(stage(spark, docs, sf_dir), table)
        if last:
            scratch.drop(last)
        last = table
    return STAGES[-1][1](spark, docs, sf_dir)
