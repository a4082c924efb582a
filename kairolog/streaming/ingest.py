"""Streams append to the fact log: one transaction for each micro-batch. Queries stay batch queries.

A batch takes its transaction counter from the log and notes it under the query's id and the batch's number before it
writes. A batch that is run again writes again under the same counter and time, so its facts are the same ones, which
every view of the log counts once; one that is known to be whole is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kairolog.functions.values import TAGGED
from kairolog.sources.log import FactLog

FOREVER = (1 << 63) - 1


def write_batch(log: FactLog, batch: DataFrame, query: str, number: int) -> None:
    """``batch``: e, a, v (tagged), valid_from, valid_to, asserted."""
    key = f"{query}-{number}."
    noted = [n for n in log.folder.names("_batches") if n.startswith(key)]
    if f"{key}whole" in noted:
        return
    log.refresh()
    if noted:
        count, tx_id = map(int, noted[0][len(key) :].split("-"))
    else:
        count, tx_id = log.take()
        log.folder.mark(f"_batches/{key}{count}-{tx_id}")
    now = F.lit(tx_id).cast("bigint")
    log.append(batch.select("e", "a", F.col("v").cast(TAGGED).alias("v"), now.alias("tx_id"), F.lit(count).cast("bigint").alias("tx_count"), F.coalesce("valid_from", now).alias("valid_from"), F.coalesce("valid_to", F.lit(FOREVER)).alias("valid_to"), "asserted"))
    log.folder.mark(f"_batches/{key}whole")


def append_facts(stream: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Append the stream to the log at ``path``. ``name`` tells streams into one log apart, and stays the same when one is started again."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(FactLog(batch.sparkSession, path), batch, name, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
