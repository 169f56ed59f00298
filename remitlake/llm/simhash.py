"""Near duplicates by SimHash: chains of segments on a ring find candidates, pruned segment by segment.

The 64 bits are four segments of 16 on a ring. If two fingerprints differ in at most 3 bits, there is a segment from which
on every chain of l = 1, 2, 3, 4 segments holds at most l * 3 / 4 differing bits, that is 0, 1, 2, 3 (the pigeonring
principle). Chains of two are looked up by key: the first segment as it is and the second, one of its four nibbles masked,
in which the one allowed difference may lie. Pairs that meet are pruned by the chains of two and three before all 64
bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bounded, stored, whole_text
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
SEGMENTS, WIDE = 4, 16
#: A key with more fingerprints than this is compared in blocks of about this many, each pair of blocks in a task of its own.
BLOCK = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles_of(text: str, size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words joined by one space, repeats included; with fewer words the whole sequence, with none nothing."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at the bytes 0x20 and 0x09 to 0x0D
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-size] + 1]
    return [joined[s:e] for s, e in zip(starts.tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: str) -> int:
    """Bit i is 1 if it is set in over half the shingles' XXH64; a text without words has 0."""
    shingles = shingles_of(text)
    if not shingles:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = np.fromiter((fingerprint(t.as_py()) for t in part.column(0)), dtype=np.uint64, count=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(found.view(np.int64))], names=[*part.schema.names[1:], "fp"]
            )


def _turn(values: np.ndarray, start: int) -> np.ndarray:
    """The fingerprints with segment ``start`` first: the ring as seen from there."""
    by = U64(WIDE * start)
    return values if not start else (values >> by) | (values << (U64(64) - by))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): per start and masked nibble of the next segment one key of 16 + 12 bits, named by start and nibble."""
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        keys = []
        for start in range(SEGMENTS):
            turned = _turn(values, start) & U64(0xFFFFFFFF)
            for nibble in range(4):
                keys.append((turned & ~(U64(0xF) << U64(WIDE + 4 * nibble))) | (U64(4 * start + nibble) << U64(32)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(values, len(keys)).view(np.int64))],
            names=["key", "fp"],
        )


def chain_hits(one: np.uint64, others: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places in ``others``, seen from the chain's first segment, that keep within the budgets of all its prefixes."""
    differing = others ^ one
    places = np.arange(len(others))
    for length in range(1, SEGMENTS + 1):
        inside = U64((1 << (WIDE * length)) - 1)
        within = np.bitwise_count(differing & inside) <= length * bits // SEGMENTS
        places, differing = places[within], differing[within]
    return places


def forest(values: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links among the distinct fingerprints of a key, as pairs of places: a spanning forest, not all pairs."""
    turned = _turn(values, start)
    label = np.arange(len(values))
    links = []
    for i in range(len(values) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            continue
        near = rest[chain_hits(turned[i], turned[rest])]
        for j in near.tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) within complete groups of (key, block pair), which arrive one after the other."""

    def links(keys: np.ndarray, marks: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])) + 1
        out: list[list] = [[], []]
        for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(keys)].tolist()):
            if hi - lo > 1:
                group = values[lo:hi]
                for i, j in forest(group, int(keys[lo]) >> 34):
                    out[0].append(group[i])
                    out[1].append(group[j])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in out], names=["u", "v"]
        )

    held: tuple = ()
    for batch in batches:
        now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
        held = tuple(np.concatenate(x) for x in zip(held, now)) if held else now
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
        if len(last):
            yield links(*(x[: last[-1] + 1] for x in held))
            held = tuple(x[last[-1] + 1 :] for x in held)
    if held and len(held[0]):
        yield links(*held)


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all fingerprints of ``distinct`` (fp) at 3 or fewer differing bits.

    Every pair within the limit shares a key and is either linked there or already connected there. A key of more than
    ``block`` fingerprints is dealt to blocks, and each pair of blocks is compared in a group of its own.
    """
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(shared.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "keys")
    entries = keyed.join(bounded(shared, 24 * shared.count()), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other),
    )
    dealt = entries.select("key", F.explode(pairs).alias("mark"), "fp")
    sorted_ = dealt.repartition("key", "mark").sortWithinPartitions("key", "mark")
    return sorted_.mapInArrow(_compare, "u long, v long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = (), block: int = BLOCK
) -> DataFrame:
    """Per row ``id_col``, ``columns``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Rows whose fingerprints differ in 3 or fewer of 64 bits are linked; ``component_id`` is the smallest id reachable,
    the row's own included, nulls left out: it is null where no reachable row has an id. Equal texts share a fingerprint
    and collapse to one node first. Null and empty texts and those without words have the fingerprint zero and are linked
    like any other. Rows that repeat an id each have their own fingerprint. No rows in, none out. ``columns`` named like
    the results are refused.
    """
    taken = {"fp", "fingerprint", "component_id"} & {id_col, *columns}
    if taken:
        raise ValueError(f"columns named like results: {sorted(taken)}")
    carried = [id_col, *dict.fromkeys(c for c in columns if c != id_col)]
    texts = docs.select(whole_text(text_col).alias("_text"), *[F.col(f"`{c}`") for c in carried])
    schema = T.StructType([texts.schema[c] for c in carried]).add("fp", "long")
    rows = stored(texts.mapInArrow(_fingerprints, schema), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = components(fingerprint_links(nodes, block)).select(F.col("node").alias("fp"), "label")
    named = nodes.join(stored(labels, "labels"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stored(named, "labelled")
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    found = stored(named.join(groups, "label").select("fp", "component_id"), "groups")
    joined = rows.join(bounded(found.withColumn("grouped", F.lit(True)), 32 * found.count()), "fp", "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in carried],
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col(f"`{id_col}`")).alias("component_id"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
