"""Token ids in binary shards with a minimal perfect hash from document keys to places.

A store is a Parquet folder with one row per shard, so that writing and reading go through Spark to any file system and
a lost task leaves no half-written file. Columns of a shard:

    part, shard       order of the shards; within them documents stand in ascending order of their key, nulls first
    n_docs, n_null, n_tokens, min_key, max_key
    payload           ids of the documents back to back, little-endian unsigned 32-bit
    ends              place in the payload, in ids, at which each document ends; little-endian 64-bit
    levels            bits of the hash's levels, back to back; level_bits has their lengths
    prints            per slot a 16-bit fingerprint of its key
    slots             per slot the number of the key's first document; little-endian 32-bit
    repeats           per slot how many documents have the key
    keys              the distinct keys, ascending, little-endian 64-bit: for listing, not needed to find one
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bounded, mix, new_path, whole_text
from .tokenizer_cache import cached

TOKENIZER, END = "word_bpe_49k.json", 2
#: Ids after which a shard is closed; shards per file.
SHARD_TOKENS, SHARDS_PER_FILE = 1 << 18, 32

SCHEMA = (
    "part int, shard int, n_docs long, n_null long, n_tokens long, min_key long, max_key long, payload binary, "
    "ends binary, level_bits array<int>, levels binary, prints binary, slots binary, repeats binary, keys binary"
)


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U64(bits)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a key's level is the first where no other one left has its bit;
    its slot is the number of bits set before its own."""

    def __init__(self, level_bits: list[int], levels: np.ndarray) -> None:
        self.level_bits = level_bits
        self.bits = np.unpackbits(levels)[: sum(level_bits)].astype(bool)
        self.rank = np.cumsum(self.bits) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        level_bits, levels, left = [], [], keys
        while len(left):
            bits = 2 * len(left)
            at = _place(left, len(level_bits), bits)
            alone = np.bincount(at, minlength=bits) == 1
            level_bits.append(bits)
            levels.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate(levels)) if levels else np.empty(0, dtype=np.uint8)
        return cls(level_bits, packed)

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or any slot, for keys that are not in the set: the fingerprint tells."""
        out, base = np.full(len(keys), -1, dtype=np.int64), 0
        for level, bits in enumerate(self.level_bits):
            open_ = np.flatnonzero(out < 0)
            at = base + _place(keys[open_], level, bits)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            base += bits
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xD6E8FEB86659FD93)) >> U64(48)).astype(np.uint16)


def _shard(part: int, shard: int, keys: list, ids: list[bytes]) -> pa.RecordBatch:
    n_null = sum(k is None for k in keys)
    known, first, repeats = np.unique(np.array(keys[n_null:], dtype=np.int64), return_index=True, return_counts=True)
    names = known.view(U64)
    index = PerfectHash.build(names)
    slots = index.slots(names)
    by_slot = np.empty(len(known), dtype=np.int64)
    by_slot[slots] = np.arange(len(known))
    ends = np.cumsum([len(x) // 4 for x in ids])
    values = [
        part, shard, len(keys), n_null, int(ends[-1]), *((int(known[0]), int(known[-1])) if len(known) else (None, None)),
        b"".join(ids), ends.astype("<i8").tobytes(), index.level_bits, index.packed(),
        fingerprints(names)[by_slot].astype("<u2").tobytes(), (first + n_null)[by_slot].astype("<i4").tobytes(),
        repeats[by_slot].astype("<i4").tobytes(), known.astype("<i8").tobytes(),
    ]
    names_kinds = [(f.split()[0], f.split()[1]) for f in SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays(
        [pa.array([v], kinds[k]) for v, (_, k) in zip(values, names_kinds)], names=[n for n, _ in names_kinds]
    )


def _writer(tokenizer: str, end: int, shard_tokens: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, tail, part, shard = cached(tokenizer), end.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                for key, x in zip(few.column(0).to_pylist(), t.encode(few.column(1).to_pylist())):
                    keys.append(key)
                    ids.append(x + tail)
                    size += len(ids[-1]) // 4
                    if size >= shard_tokens:
                        yield _shard(part, shard, keys, ids)
                        keys, ids, size, shard = [], [], 0, shard + 1
        if keys:
            yield _shard(part, shard, keys, ids)

    return emit


def write_store(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str = TOKENIZER, end: int = END, shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Writes the ids of every whole text, followed by ``end``, to a new store at ``path`` in ascending order of the key.

    Null and empty texts hold ``end`` alone. Null keys come first and are not indexed; documents that repeat a key
    stand together, in an order of their texts' hashes. No rows give an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("key"), whole_text(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h").select("key", "text")
    ordered.mapInArrow(_writer(tokenizer, end, shard_tokens), SCHEMA).write.option("compression", "zstd").option(
        "maxRecordsPerFile", SHARDS_PER_FILE
    ).parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


class Shard:
    """One shard in memory; ``find`` takes constant time per key."""

    def __init__(self, row: dict) -> None:
        self.n_null = row["n_null"]
        self.ids = np.frombuffer(row["payload"], dtype="<u4")
        self.ends = np.frombuffer(row["ends"], dtype="<i8")
        self.index = PerfectHash(row["level_bits"], np.frombuffer(row["levels"], dtype=np.uint8))
        self.prints, self.first, self.repeats = (
            np.frombuffer(row[c], dtype=k) for c, k in (("prints", "<u2"), ("slots", "<i4"), ("repeats", "<i4"))
        )

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each key's first document, or -1 where the key is not stored, and how many it has."""
        if not len(self.first):
            return np.full(len(keys), -1), np.zeros(len(keys), dtype=int)
        names = keys.view(U64)
        slots = self.index.slots(names)
        stored_here = (slots >= 0) & (self.prints[slots] == fingerprints(names))
        return np.where(stored_here, self.first[slots], -1), np.where(stored_here, self.repeats[slots], 0)

    def document(self, number: int) -> tuple[int, np.ndarray]:
        """Place of a document in the payload, and its ids."""
        low = int(self.ends[number - 1]) if number else 0
        return low, self.ids[low : int(self.ends[number])]


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """``key``, ``ids`` of the documents with one of ``keys``, a request of bounded length. Shards whose key range holds
    none are skipped by the scan. A key that is not stored gives no row but with a chance of 2^-16."""
    wanted = np.unique(np.array(keys, dtype=np.int64))
    shards = open_store(spark, path)
    here = F.lit(False)
    for k in wanted.tolist():
        here |= (F.col("min_key") <= k) & (F.col("max_key") >= k)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                first, repeats = shard.find(wanted)
                out = [(k, shard.document(f + j)[1].tolist()) for k, f, r in zip(wanted.tolist(), first, repeats) for j in range(r)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))],
                    names=["key", "ids"],
                )

    return shards.where(here).mapInArrow(emit, "key long, ids array<long>")


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """All documents of a store, each fetched by its key: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before. The totals of the write tasks, one number each, are added up on
    the driver; those of a task's shards within that task's group.
    """
    shards = open_store(spark, path)
    sizes = shards.select("part", "shard", "n_tokens")
    base, bases = 0, []
    for row in sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        bases.append((row["part"], base))
        base += row["n"]
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select(
        "part", "shard", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("start")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, listed = Shard(row), np.frombuffer(row["keys"], dtype="<i8")
                first, repeats = shard.find(listed)
                numbers = [*((None, j) for j in range(shard.n_null))]
                numbers += [(k, f + j) for k, f, r in zip(listed.tolist(), first.tolist(), repeats.tolist()) for j in range(r)]
                found = [shard.document(j) for _, j in numbers]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in numbers], pa.int64()),
                        pa.array([row["start"] + low for low, _ in found], pa.int64()),
                        pa.array([len(x) for _, x in found], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for _, x in found], pa.int64()),
                    ],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.join(bounded(starts, 32 * starts.count()), ["part", "shard"])
    return placed.mapInArrow(emit, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path)
