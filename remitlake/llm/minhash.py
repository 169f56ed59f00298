"""Near duplicates: minima of universal hashes, banding, verification on whole sets, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bounded, mix, rolling, stored, whole_text, word_hashes
from .components import components

BANDS, ROWS, SHINGLE, PERCENT = 40, 4, 5, 75
#: Members of a bucket that are compared with all others of it in one round.
HUBS = 4096
#: Minima of the finer sketch that documents of undecided buckets get; members of a bucket that travel in one row.
FINE, BLOCK = 1024, 512


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle of its own length."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space as defined
    if not words:
        return np.empty(0, dtype=U64)
    hashes, short = word_hashes(words), min(width, len(words))
    return np.unique(mix(rolling(hashes, short) + U64(short)))


def _hashes(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``count`` universal hash functions modulo 2^64."""
    draw = np.random.RandomState(seed).randint(0, 1 << 32, size=(4, count)).astype(U64)
    return (draw[0] << U64(32) | draw[1]) | U64(1), draw[2] << U64(32) | draw[3]


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least, step = np.full(len(a), ~U64(0), dtype=U64), max(1, (1 << 16) // len(a))
    for at in range(0, len(values), step):
        np.minimum(least, (values[at : at + step, None] * a + b).min(axis=0), out=least)
    return least


def _fine_sketcher(width: int):
    a, b = _hashes(FINE, 11)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [_sketch(_minima(shingle_set(t, width), a, b)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sketches, pa.list_(pa.int64()))], names=["rep", "fine"]
            )

    return emit


def _sketcher(width: int, bands: int, rows: int):
    a, b = _hashes(bands * rows, 7)
    names = mix(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))

    def bands_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = _minima(values, a, b)
        key = names.copy()
        for row in least.reshape(bands, rows).T:
            key = mix(key ^ row) * U64(0x9E3779B97F4A7C15)
        return mix(key), _sketch(least)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1024):
                sets = [shingle_set(t, width) for t in texts.slice(at, 1024).to_pylist()]
                none = (np.empty(0, dtype=U64),) * 2
                both = [bands_of(s) if len(s) else none for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 1024),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        *(pa.array([b[i].view(np.int64) for b in both], pa.list_(pa.int64())) for i in (0, 1)),
                    ],
                    names=["doc", "n", "digest", "bands", "sketch"],
                )

    return sketch


def _sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 of them to a word."""
    two = np.zeros(-(-len(least) // 32) * 32, dtype=U64)
    two[: len(least)] = mix(least) & U64(3)
    return np.bitwise_or.reduce(two.reshape(-1, 32) << (U64(2) * np.arange(32, dtype=U64)), axis=1)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _verifier(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in (part.slice(at, 2048) for part in batches for at in range(0, part.num_rows, 2048)):
            a, b, text_a, text_b = (batch.column(i).to_pylist() for i in range(4))
            keep, held = [], held if len(held) < 4096 else {}
            for ids, texts in ((a, text_a), (b, text_b)):
                for i, doc in enumerate(ids):
                    if doc not in held:
                        held[doc] = shingle_set(texts[i], width)
            for i, hub in enumerate(a):
                x, y = held[hub], held[b[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"]
            )

    return verify


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """Component of every document under "shares at least ``percent`` per cent of the union of shingles".

    One row per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``.

    * Equal sets are one class, represented by its smallest id; only classes are banded. Two sets at the limit of 75 per
      cent miss each other in all 40 bands of 4 with a chance of 3e-7.
    * A bucket's members are first compared with its smallest member. Where members then still differ in component,
      further members are compared with all those of other components, ``HUBS`` a round, until no such pair is
      left untested: every pair that shares a bucket is confirmed, refuted or already connected, whatever the bucket's
      size, and a round compares at most ``HUBS`` times the members.
    * Of the pairs of a bucket, only those are fetched for the confirmation whose set sizes allow the similarity and whose
      sketches (two bits of each minimum) differ in no more places than six standard deviations above the expectation
      at the limit; beyond the first comparison also a finer sketch, with five: a chance of 3e-7 to miss a pair.
    * Null, empty or blank text: no shingle, own component, kept. Null id: ``component_id`` null, kept, linked with nothing.
      Rows that repeat an id are one document of the graph. Other columns are not looked at. No rows in, none out.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc"), whole_text(text_col).alias("text"))
    schema = "doc long, n long, digest binary, bands array<long>, sketch array<long>"
    sketches = stored(d.mapInArrow(_sketcher(width, bands, rows), schema), "sketches")
    usable = sketches.where("n > 0 AND doc IS NOT NULL")
    classes = stored(
        usable.groupBy("digest").agg(F.min(F.struct("doc", "n", "bands", "sketch")).alias("c"))
        .select("digest", F.col("c.doc").alias("rep"), "c.n", "c.bands", "c.sketch"),
        "classes",
    )
    of_rep = classes.select("rep", "n", "sketch").dropDuplicates(["rep"])
    of_hub = of_rep.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    bucketed = classes.select("rep", F.explode("bands").alias("key"))
    shared = bucketed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).where("size > 1")
    members = stored(bucketed.join(shared.select("key", "hub"), "key").join(of_rep, "rep"), "buckets")
    stars = members.where("rep <> hub").dropDuplicates(["rep", "hub"])
    pairs = stars.join(of_hub, "hub").where(_alike(percent, bands * rows))
    pairs = _ordered(pairs)
    tested = stored(pairs, "pairs")
    edges = stored(_confirmed(spark, tested, d, width, percent), "links")
    labels = components(edges)
    fine = None
    done = members.select("key", "hub").distinct().withColumnRenamed("hub", "rep")
    while True:
        now = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", "n", F.coalesce("label", "rep").alias("label")
        )
        split = now.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
        live = stored(now.join(split, "key", "left_semi").join(done, ["key", "rep"], "left_anti"), "open")
        if fine is None:
            texts = _texts(d, live.select(F.col("rep").alias("doc")))
            fine = stored(texts.mapInArrow(_fine_sketcher(width), "rep long, fine array<long>"), "fine")
        live = live.join(fine, "rep").join(classes.select("rep", "bands").dropDuplicates(["rep"]), "rep")
        most = (
            live.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("labels"))
            .where("labels > 1").select("key", F.col("top.label").alias("top"), (F.col("size") - F.col("top.c")).alias("others"))
        )
        salt = F.when(F.col("others") <= HUBS, F.xxhash64("rep")).otherwise(F.pmod(F.xxhash64("rep"), F.lit(HUBS)))
        hubs = stored(
            live.join(most, "key").where("label <> top").groupBy("key", salt.alias("salt"))
            .agg(F.min(F.struct("rep", "n", "label", "fine", "bands")).alias("h"), F.max("others").alias("others"))
            .select("key", "h.*", "others"),
            "hubs",
        )
        largest = hubs.agg(F.max("others")).first()[0]
        if largest is None:
            break
        met = _packed(live, "members").join(_packed(hubs, "hubs"), "key").select("members", "hubs", "key")
        fresh = met.mapInArrow(_comparer(percent, bands), "u long, v long").distinct()
        fresh = stored(fresh.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = tested.unionByName(fresh)
        done = done.unionByName(hubs.select("key", "rep"))
        new = stored(_confirmed(spark, fresh, d, width, percent), "links")
        if not new.isEmpty():
            labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(new))
        if largest <= HUBS:  # every pair of every bucket is settled
            break
    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("label", "rep").alias("label")
    )
    out = sketches.select("doc", "n", F.when(F.expr("n > 0 AND doc IS NOT NULL"), F.col("digest")).alias("digest"))
    return out.join(of_class, "digest", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("label", "doc").alias("component_id"),
        F.coalesce(F.col("doc") == F.coalesce("label", "doc"), F.lit(True)).alias("kept"),
    )


def _most_differences(minima: int, percent: int, deviations: float) -> int:
    """In how many places two-bit sketches of sets at the limit differ at most, but for so many standard deviations."""
    p = 0.75 * (1 - percent / 100)
    return math.ceil(minima * p + deviations * math.sqrt(minima * p * (1 - p)))


def _alike(percent: int, minima: int) -> Column:
    """Set sizes and sketches that allow the similarity."""
    differ = F.lit(0)
    for i in range(-(-minima // 32)):
        x = F.get("sketch", F.lit(i)).bitwiseXOR(F.get("hub_sketch", F.lit(i)))
        differ += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    sizes = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    return sizes & (differ <= _most_differences(minima, percent, 6.2))


def _packed(members: DataFrame, name: str) -> DataFrame:
    """Members of a bucket in rows of about BLOCK."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    return dealt.groupBy("key", "block").agg(F.collect_list(F.struct("rep", "n", "label", "fine", "bands")).alias(name)).drop("block")


def _comparer(percent: int, bands: int):
    """Pairs of a member and a hub of different components whose sizes and finer sketches allow the similarity; of all
    buckets that they share, only the first one names them."""
    most, words, low = _most_differences(FINE, percent, 5), -(-FINE // 32), U64(0x5555555555555555)

    def unpacked(rows: pa.Scalar) -> list[np.ndarray]:
        rep, n, label, fine, keys = rows.values.flatten()
        wide = [fine.flatten().to_numpy().view(U64).reshape(-1, words), keys.flatten().to_numpy().reshape(-1, bands)]
        return [rep.to_numpy(), n.to_numpy(), label.to_numpy(), *wide]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, (rep, n, label, fine, keys), hubs = batch.column(2)[i].as_py(), *map(unpacked, (batch.column(j)[i] for j in (0, 1)))
                u, v = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
                for hub, hub_n, hub_label, hub_fine, hub_keys in zip(*hubs):
                    fits = 100 * np.minimum(n, hub_n) >= percent * np.maximum(n, hub_n)
                    at = np.flatnonzero(fits & (label != hub_label))
                    x = fine[at] ^ hub_fine
                    at = at[np.bitwise_count((x | x >> U64(1)) & low).sum(axis=1) <= most]
                    at = at[hub_keys[(keys[at] == hub_keys).argmax(axis=1)] == key]
                    u.append(np.minimum(rep[at], hub))
                    v.append(np.maximum(rep[at], hub))
                pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return compare


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()


def _texts(d: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, text) of ``ids``, which are sent to the scan if they are few."""
    ids = stored(ids.distinct(), "ids")
    found = d.where("doc IS NOT NULL").join(bounded(ids, 16 * ids.count()), "doc", "left_semi")
    return found.dropDuplicates(["doc"])


def _confirmed(spark: SparkSession, pairs: DataFrame, d: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` whose whole sets are similar enough."""
    texts = stored(_texts(d, pairs.select("u").union(pairs.select("v")).withColumnRenamed("u", "doc")), "texts")
    u = texts.select(F.col("doc").alias("u"), F.col("text").alias("text_u"))
    v = texts.select(F.col("doc").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(_verifier(width, percent), "u long, v long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
