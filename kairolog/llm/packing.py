"""Packing: concatenate and cut, with two-pass prefix sums.

Pass one encodes each partition's documents and notes where each begins among the partition's tokens. The totals of
the partitions, one number each, are summed on the driver into offsets; pass two adds them and cuts the concatenation
at every multiple of the sequence length. A document that crosses a cut leaves a boundary record, a piece, on either
side. Only the last sequence needs padding.

Encoding goes through a bounded cache of parts of words, since neither whitespace nor the edge between letters and marks
lies within a token of the vocabulary.

Cases: a null or empty text is the end mark alone; repeated rows are packed once each; null ids are kept; extra columns
are ignored; an empty table gives an empty result; a text of any length spans as many sequences as it needs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm._tables import materialize, ship
from kairolog.llm._words import sized

SEQUENCE, END = 4096, 2
CACHED_PARTS = 600_000
SLICE = 16 << 20
#: A run of Latin letters, then marks: the pre-tokenizer cuts it between the two, and lower-casing is letter by letter.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\\[-`{}~]*)")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Word ids as arrays, cached; one per worker process and vocabulary."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.part: dict[str, bytes] = {"": b""}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = cls(vocabulary)
        return _encoders[vocabulary]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: of its letters, which are cached, and of the marks after them."""
        if len(self.part) > CACHED_PARTS:  # the newer half stays
            self.part = {"": b""} | dict(islice(self.part.items(), len(self.part) // 2, None))
        parts, match = self.part, PLAIN.fullmatch
        heads, tails = list(words), [""] * len(words)
        for i, w in enumerate(words):
            if m := match(w):
                head, tails[i] = m.groups()
                heads[i] = head.lower()
        new = [*set(heads).difference(parts), *set(tails).difference(parts)]
        for lo in range(0, len(new), 10_000):
            some = new[lo : lo + 10_000]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            body, width = np.fromiter(chain.from_iterable(coded), self.dtype).tobytes(), self.dtype.itemsize
            ends = (np.cumsum([0, *map(len, coded)]) * width).tolist()
            parts.update(zip(some, (body[a:b] for a, b in pairwise(ends)), strict=True))
        return [parts[a] + parts[b] if b else parts[a] for a, b in zip(heads, tails, strict=True)]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each begins, and the end."""
        lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.empty(0, self.dtype), np.zeros(len(column) + 1, np.int64)
        known = self.words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), self.dtype)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        begin, index = np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[index] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[bounds]


def _encode(vocabulary: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0
        mark = np.array([end], encoder.dtype).tobytes()
        for batch in sized(batches, "text", SLICE):
            ids, bounds = encoder.texts(batch.column("text"))
            body, width = memoryview(ids.tobytes()), encoder.dtype.itemsize
            blobs = [bytes(body[a * width : b * width]) + mark for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            n = np.diff(bounds) + 1
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(begin), pa.array(n), pa.array(blobs, pa.binary())], ["doc_id", "part", "begin", "doc_tokens", "ids"])

    return run


def _cut(sequence: int, width: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, place, blobs = [], [], [], [], [], []
            for i, (at, n, body) in enumerate(zip(batch.column("at").to_pylist(), batch.column("doc_tokens").to_pylist(), batch.column("ids"), strict=True)):
                ids = np.frombuffer(body.as_buffer(), f"<u{width}").astype("<u4")
                lo = 0
                while lo < n:
                    hi = min(n, lo + sequence - (at + lo) % sequence)
                    piece = ids[lo:hi].tobytes()
                    row.append(i), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(piece)), place.append(at + lo)
                    if with_ids:
                        blobs.append(piece)
                    lo = hi
            place = np.array(place, np.int64)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column("doc_tokens").take(pa.array(row, pa.int64())), pa.array(place // sequence), pa.array(place % sequence)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian uint32)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = materialize(docs.select("doc_id", "text").mapInArrow(_encode(vocabulary, end), f"doc_id {kind}, part long, begin long, doc_tokens long, ids binary"), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("begin") + F.col("doc_tokens")).alias("n")).orderBy("part").collect()  # a row per partition
    parts, n = [r["part"] for r in totals], np.array([r["n"] for r in totals], np.int64)
    before = docs.sparkSession.createDataFrame(pa.table({"part": pa.array(parts, pa.int64()), "before": pa.array(np.cumsum(n) - n, pa.int64())}))
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("begin")).alias("at"), "doc_tokens", "ids")
    width = Encoder.of(vocabulary).dtype.itemsize
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(_cut(sequence, width, with_ids), schema)
