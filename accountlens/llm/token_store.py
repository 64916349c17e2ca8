"""Token ids in binary shards with Elias-Fano document boundaries.

A shard is a row of a Parquet dataset: the ids of some documents, one after the
other, as 16- or 32-bit integers, and two Elias-Fano sequences: where each
document ends, and the documents' own ids. A sequence of n values below u takes
about n * (2 + log2(u / n)) bits, and a select directory returns any value
without decoding the rest. Spark's writer commits the files, so the dataset lies
in any store that Spark writes, and lost tasks are repeated.

Defined cases: null and empty texts hold only the end id; documents follow each
other by ascending id, null ids first, ties by the hash of the text; a text of any length stays
in one shard; an empty table gives an empty dataset; other columns do not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import parts
from .bpe import json_classes, json_codec

#: A shard is closed when it holds so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 14
SAMPLE = 64
_HEAD = struct.Struct("<QQqB")
SCHEMA = "part int, seq int, n_docs long, n_ids long, width int, n_null long, doc_ids binary, ends binary, ids binary"


class EliasFano:
    """Ascending integers, repeats allowed, as packed low bits and a unary bit vector of the high bits."""

    def __init__(self, n: int, low_bits: int, base: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.base, self.low, self.high, self.samples = n, low_bits, base, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        rest = (values - base).astype(np.uint64)
        universe = int(rest[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (rest >> np.uint64(bits)).astype(np.int64)
        ones = high + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        low = (rest[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        return cls(n, bits, base, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        return _HEAD.pack(self.n, len(self.high), self.base, self.low_bits) + self.high.tobytes() + self.samples.astype("<u4").tobytes() + self.low.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, size, base, bits = _HEAD.unpack_from(data)
        at = _HEAD.size
        high = np.frombuffer(data, np.uint8, size, at)
        count = -(-n // SAMPLE)
        samples = np.frombuffer(data, "<u4", count, at + size)
        return cls(n, bits, base, np.frombuffer(data, np.uint8, offset=at + size + 4 * count), high, samples)

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        place = i[:, None] * self.low_bits + np.arange(self.low_bits)[None, :]
        bits = (self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value: from the last sampled one bit, only the bytes up to the wanted bit are read."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, start >> 3
        word = int(self.high[byte]) >> (start & 7) << (start & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return self.base + ((place - i) << self.low_bits) + int(self._low_at(np.array([i]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return self.base + ((ones - i).astype(np.int64) << self.low_bits) + (self._low_at(i) if self.low_bits else 0)


def _shard(part: int, seq: int, doc_ids: list, ids: list[np.ndarray], width: int) -> dict:
    lens = np.array([len(x) for x in ids], np.int64)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    return {
        "part": part, "seq": seq, "n_docs": len(ids), "n_ids": int(lens.sum()), "width": width, "n_null": len(ids) - len(known),
        "doc_ids": EliasFano.of(known).dump(), "ends": EliasFano.of(np.cumsum(lens)).dump(), "ids": np.concatenate(ids).astype(f"<u{width}").tobytes(),
    }


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends the end id, and writes the shards in ascending order of the documents' ids."""
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("n_null", pa.int64()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary())])
    classes = json_classes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, seq = json_codec(vocabulary, classes), TaskContext.get().partitionId(), 0
        width = 2 if len(codec.tokens) <= 1 << 16 else 4
        end = np.array([end_id], np.int32)
        doc_ids, held, size = [], [], 0
        for batch in (x for whole in batches for x in parts(whole)):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            for doc_id, ids in zip(batch.column("_key").to_pylist(), codec.encode(texts), strict=True):
                doc_ids.append(doc_id)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= SHARD_IDS or len(held) >= SHARD_DOCS:
                    yield pa.RecordBatch.from_pylist([_shard(part, seq, doc_ids, held, width)], arrow)
                    doc_ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, doc_ids, held, width)], arrow)

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    # By id and hash, so that rows without an id, or of one, spread over tasks too.
    kept.repartitionByRange("_key", "_hash").sortWithinPartitions("_key", "_hash", "_text").select("_key", "_text").mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of a dataset of shards; start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ends = EliasFano.load(x["ends"]).values()
                starts = np.concatenate([[0], ends[:-1]])
                doc_ids = [None] * x["n_null"] + EliasFano.load(x["doc_ids"]).values().tolist()
                ids = np.frombuffer(x["ids"], f"<u{x['width']}").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["part"]] * n, pa.int32()), pa.array([x["seq"]] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["_part", "_seq", "_key", "_local", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.parquet(path)
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each task that wrote
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = shards.select("part", "seq", inside.alias("inside")).join(per_part.select("part", before.alias("before")), "part")
    first = first.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), (F.col("before") + F.col("inside")).alias("_first"))
    docs = shards.select("part", "seq", "width", "n_null", "doc_ids", "ends", "ids").mapInArrow(run, "_part int, _seq int, _key long, _local long, n_tokens long, ids_crc32 long")
    return docs.join(first, ["_part", "_seq"]).select(F.col("_key").alias(id_col), (F.col("_first") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32")


def shard_document(shard: dict, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard row, found by select alone."""
    ends = EliasFano.load(shard["ends"])
    a, b = ends.select(i - 1) if i else 0, ends.select(i)
    return np.frombuffer(shard["ids"], f"<u{shard['width']}", b - a, a * shard["width"])
