"""Toxicity by a factorization machine over hashed terms.

A document's features are its distinct lower-cased terms and six-byte term beginnings, hashed; a score is the logistic
of bias + linear weights + the pairwise interactions of k-dimensional factors, so two terms can mean together what
neither means alone. The model is fitted on the driver on a bounded sample of labelled rows (``SAMPLE``; the smallest
hashes of doc_id among rows that are not held out); workers send it distinct feature numbers, never texts. All
documents are scored, over their whole texts.

Rows whose crc32(doc_id as text) modulo 3 is 1 are held out: their labels are never read. Language, source, id and
label are no features.

Cases: null or wordless texts score the bias alone; null ids hash as the empty text and are not held out; a document
labelled twice counts twice, rows repeated whole once; extra columns are ignored; without both labels in the sample every score is the share of
label 1 (0.5 with none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import ship
from kairolog.llm._words import sized, split_words, utf8, word_hashes

SAMPLE = 12_000
BITS, FEATURES, FACTORS, EPOCHS, STEPS, BATCH, PREFIX = 20, 6000, 6, 12, 800, 128, 6
THRESHOLD, HELD_OUT = 0.7, 1
_TERM = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


class Model(NamedTuple):
    bias: float
    slot: np.ndarray  # feature number to row of the weights, or -1
    linear: np.ndarray
    factors: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == HELD_OUT


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, possibly repeated."""
    data, bounds = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    data = _TERM[data]
    start, end, first = split_words(data, bounds)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    short = np.minimum(end, start + PREFIX)
    mask = np.uint64((1 << BITS) - 1)
    terms, heads = word_hashes(data, start, end) & mask, (word_hashes(data, start, short) >> np.uint64(BITS)) & mask
    return np.concatenate([doc, doc]), np.concatenate([terms, heads]).astype(np.int64)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, "text"):
        doc, feature = features(batch.column("text"))
        pairs = np.unique((doc << BITS) | feature)
        ends = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), lists], ["order", "y", "features"])


def chosen(index: np.ndarray, row: np.ndarray, y: np.ndarray, count: int = FEATURES) -> np.ndarray:
    """The features whose presence depends most on the label (by the chi-squared statistic)."""
    present = np.bincount(index, minlength=1 << BITS).astype(float)
    positive = np.bincount(index, y[row], 1 << BITS)
    n, p = len(y), y.mean()
    expected = present * p
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (positive - expected) ** 2 / (expected * (1 - p) * np.maximum(1 - present / n, 1e-6))
    chi[(present < 3) | ~np.isfinite(chi)] = 0
    best = np.argsort(-chi, kind="stable")[:count]
    return np.sort(best[chi[best] > 3])


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """By AdaGrad over shuffled batches; the same rows give the same model."""
    slot = np.full(1 << BITS, -1, np.int32)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
        return Model(float(np.log(p / (1 - p))), slot, np.zeros(0), np.zeros((0, FACTORS)))
    index = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    kept = chosen(index, row, y)
    slot[kept] = np.arange(len(kept))
    rows = [s[s >= 0] for s in (slot[r] for r in rows)]
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), FACTORS))
    gw, gv, gb = np.full(len(kept), 1e-2), np.full(v.shape, 1e-2), 1e-2
    weight = np.where(y > 0, np.sqrt((y == 0).sum() / y.sum()), 1.0)  # the rarer label counts for more
    epochs = max(EPOCHS, math.ceil(STEPS * BATCH / len(rows)))
    for epoch in range(epochs):
        rate = 0.2 / (1 + 4 * epoch / epochs)
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            size = np.array([len(rows[i]) for i in part])
            at, owner = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), size)
            total = np.zeros((len(part), FACTORS))
            np.add.at(total, owner, v[at])
            square = np.bincount(owner, (v[at] ** 2).sum(1), len(part))
            z = bias + np.bincount(owner, w[at], len(part)) + 0.5 * ((total**2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
            touched, local = np.unique(at, return_inverse=True)
            dw = np.bincount(local, error[owner], len(touched)) + 1e-5 * w[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, local, error[owner, None] * (total[owner] - v[at]))
            dv += 1e-4 * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.5 * rate * dv / np.sqrt(gv[touched])
            db = error.sum()
            gb += db**2
            bias -= rate * db / np.sqrt(gb)
    return Model(float(bias), slot, w, v)


def scores(model: Model, column: pa.Array) -> np.ndarray:
    doc, feature = features(column)
    at = model.slot[feature]
    pairs = np.unique((doc[at >= 0].astype(np.int64) << 32) | at[at >= 0])
    doc, at = pairs >> 32, pairs & 0xFFFFFFFF
    n = len(column)
    v = model.factors[at]
    total = np.stack([np.bincount(doc, v[:, f], n) for f in range(model.factors.shape[1])], 1)
    z = model.bias + np.bincount(doc, model.linear[at], n) + 0.5 * ((total**2).sum(1) - np.bincount(doc, (v**2).sum(1), n))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(model: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores(model.value, batch.column("text")))], ["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", F.xxhash64("doc_id", "y", "text").alias("order"))
    # rows that repeat an id under one label and text count once, and no more rows than the sample come here
    found = rows.mapInArrow(_distinct, "order long, y int, features array<int>").dropDuplicates(["order"]).orderBy("order").limit(sample).toArrow()
    y = found["y"].to_numpy().astype(float)
    lists = [np.asarray(x.values) for x in found["features"]]
    order = sorted(range(len(y)), key=lambda i: (y[i], lists[i].tobytes()))  # whatever order the tasks ended in
    return fit([lists[i] for i in order], y[order])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = spark.sparkContext.broadcast(train(docs, labels, sample))  # of a size that the parameters fix
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
