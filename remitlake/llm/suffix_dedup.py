"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix array here holds the suffixes that start at synchronised positions: in every window of ``width`` bytes the
position whose 24 bytes hash lowest (the leftmost of equals). The choice depends on the window's bytes alone, so two
equal windows select the same place in them, and comparing these suffixes loses no match. The array is ordered by the
suffixes' first 24 bytes and stored as Parquet, hash-partitioned by them and sorted within.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bounded, mix, rolling, row_key, runs, stored, whole_text

WIDTH, DEPTH, BATCHES = 400, 24, 4
#: A group of suffixes with more distinct surroundings than this is not compared within one task.
GROUP = 2048
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def owners(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Synchronised positions, and the first and last window start that each of them is selected for."""
    n = len(data) - width + 1
    if n <= 0:
        return (np.empty(0, dtype=np.int64),) * 3
    rank = rolling(_BYTE[data], DEPTH) >> U64(32) << U64(32)
    rank |= np.arange(len(rank), dtype=U64)
    span, done = width - DEPTH + 1, 1
    while done < span:
        step = min(done, span - done)
        rank = np.minimum(rank[:-step], rank[step:])
        done += step
    chosen = (rank & U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(chosen))
    first, last = np.r_[0, cut + 1], np.r_[cut, n - 1]
    return chosen[first], first, last


def _suffixes(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prefixes, keys, places = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = as_bytes(text)
                    chosen = owners(data, width)[0]
                    raw = data.tobytes()
                    prefixes.extend(raw[p : p + DEPTH] for p in chosen.tolist())
                    keys.append(np.full(len(chosen), key, dtype=np.int64))
                    places.append(chosen.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefixes, pa.binary()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))],
                    names=["prefix", "key", "at"],
                )

    return emit


class SuffixIndex:
    """Suffix arrays of geometrically growing sizes; a batch is merge-scanned against all of them when it is added.

    Level i holds 2^i batches. A batch joins the run of full levels from 0 up into the next free one, as carrying does
    in a binary counter, so a suffix is rewritten once per level and a batch meets at most log2(batches) arrays.
    """

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.levels: list[DataFrame | None] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Index ``batch`` (key, text). Returns (key, at) of the suffixes, new and old, that match a new one."""
        new = batch.mapInArrow(_suffixes(self.width), "prefix binary, key long, at int")
        free = next((i for i, x in enumerate(self.levels) if x is None), len(self.levels))
        scanned = new.select("*", F.lit(-1).alias("level"))
        for i, level in enumerate(self.levels):
            if level is not None:
                scanned = scanned.unionByName(level.select("*", F.lit(i).alias("level")))
        same = Window.partitionBy("prefix")
        found = scanned.withColumn("matched", (F.count(F.lit(1)).over(same) > 1) & (F.min("level").over(same) == -1))
        found = stored(found.where(F.col("matched") | (F.col("level") < free)), "suffixes")
        merged = found.where(F.col("level") < free).select("prefix", "key", "at")
        self.levels = [None] * free + [merged] + self.levels[free + 1 :]
        return found.where("matched").select("key", "at")


def _surroundings(width: int):
    """For each candidate suffix the bytes of the windows that select it, and a digest naming them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[], [], [], [], [], []]
                for i, (key, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    data = as_bytes(text)
                    chosen, first, last = owners(data, width)
                    raw = data.tobytes()
                    wanted = np.isin(chosen, np.asarray(part.column(2)[i].values.to_numpy()))
                    for c, lo, hi in zip(chosen[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist()):
                        span = raw[lo : hi + width]
                        out[0].append(xxhash.xxh3_64_intdigest(raw[c : c + DEPTH]) - (1 << 63))
                        out[1].append(xxhash.xxh3_128_digest(b"%d " % (c - lo) + span))
                        out[2].append(span)
                        out[3].append(key)
                        out[4].append(lo)
                        out[5].append(c - lo)
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(out, kinds)], names=["p", "digest", "span", "key", "lo", "place"]
                )

    return emit


def _group_windows(width: int):
    """Within complete groups of ``p``: the runs of windows that also occur in another class or in a class of several."""

    def flagged(p: list, digests: list, spans: list, sizes: list) -> pa.RecordBatch:
        values = [rolling(_BYTE[np.frombuffer(s, dtype=np.uint8)], width) for s in spans]
        counts = [len(v) for v in values]
        named = np.concatenate(values) ^ np.repeat(mix(np.array(p, dtype=np.int64).view(U64)), counts)
        weight = np.repeat(np.array(sizes), counts)
        order = np.argsort(named, kind="stable")
        ordered = named[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        group = np.cumsum(new) - 1
        twice = np.empty(len(named), dtype=bool)
        twice[order] = np.bincount(group, weights=weight[order])[group] > 1
        both = [runs(np.flatnonzero(x)) for x in np.split(twice, np.cumsum(counts)[:-1])]
        return pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary())] + [pa.array([b[i] for b in both], pa.list_(pa.int32())) for i in (0, 1)],
            names=["digest", "first", "last"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for x, column in zip(held, part.columns):
                    x.extend(column.to_pylist())
                end = len(held[0])
                while end and held[0][end - 1] == held[0][-1]:
                    end -= 1
                if end:
                    yield flagged(*(x[:end] for x in held))
                    held = [x[end:] for x in held]
        if held[0]:
            yield flagged(*held)

    return emit


def _common(one: bytes, two: bytes) -> int:
    """Length of the common beginning."""
    if one[: len(two)] == two[: len(one)]:
        return min(len(one), len(two))
    low, high = 0, min(len(one), len(two))
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if one[:middle] == two[:middle] else (low, middle)
    return low


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, reach): how much of its text a class has in common with another of its group, from rows sorted by group and
    text: the neighbours have most in common. At the ends of a partition a neighbour is unknown and all may be common."""
    before = None  # group and text of the row before, and what the row held has in common with the one before it
    held: tuple | None = None
    for batch in batches:
        digests, reach = [], []
        for p, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
            shared = len(text) if before is None else _common(before[1], text) if before[0] == p else 0
            if held is not None:
                digests.append(held[0])
                reach.append(max(held[1], shared if before[0] == p else 0))
            held, before = (digest, shared), (p, text)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(reach, pa.int32())], names=["digest", "reach"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.binary()), pa.array([len(before[1])], pa.int32())], names=["digest", "reach"])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes from the suffix's place on, and those before it, backwards."""
    for batch in batches:
        p, digest, span, place = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([s[c:] for s, c in zip(span, place)], pa.binary()),
             pa.array([s[:c][::-1] for s, c in zip(span, place)], pa.binary())],
            names=["p", "digest", "right", "left"],
        )


def _possible_windows(width: int):
    """Windows that may repeat: with ``d`` bytes before the suffix's place, ``d`` of them and ``width - d`` after it must each
    be shared with some class. Windows that do so within a batch leave as runs, the others, and one of each kind, as rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                hashes, owner, places = [], [], []
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                for i, (p, _, span, place, right, left, _) in enumerate(rows):
                    first, last = max(place - left, 0), min(place + right - width, len(span) - width)
                    if last >= first:
                        piece = np.frombuffer(span, dtype=np.uint8)[first : last + width]
                        found = rolling(_BYTE[piece], width) ^ mix(np.array([p], dtype=np.int64).view(U64))
                        hashes.append(found)
                        owner.append(np.full(len(found), i))
                        places.append(np.arange(first, last + 1))
                if not hashes:
                    continue
                h, who, where = (np.concatenate(x) for x in (hashes, owner, places))
                weight = np.array([r[6] for r in rows])[who]
                order = np.argsort(h, kind="stable")
                ordered = h[order]
                new = np.r_[True, ordered[1:] != ordered[:-1]]
                group = np.empty(len(h), dtype=np.int64)
                group[order] = np.cumsum(new) - 1
                twice = np.bincount(group, weights=weight)[group] > 1
                one = np.zeros(len(h), dtype=bool)
                one[order[new]] = True
                out: list[list] = [[], [], [], [], []]
                marked = np.flatnonzero(twice)
                for piece in np.split(marked, np.flatnonzero(np.diff(who[marked])) + 1) if len(marked) else ():
                    for a, b in zip(*(x.tolist() for x in runs(where[piece]))):
                        for column, value in zip(out, (None, rows[who[piece[0]]][1], a, b, 2)):
                            column.append(value)
                alone = np.flatnonzero(one)
                out[0] += h[alone].view(np.int64).tolist()
                out[1] += [rows[i][1] for i in who[alone].tolist()]
                out[2] += where[alone].tolist()
                out[3] += where[alone].tolist()
                out[4] += np.where(twice[alone], 2, 1).tolist()
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["h", "digest", "first", "last", "size"])

    return emit


def _repeated_in_large(classes: DataFrame, width: int) -> DataFrame:
    """As ``_repeated`` for groups too large for a task: what two classes have in common bounds the windows looked at."""
    sides = stored(classes.select("p", "digest", "span", "place").mapInArrow(_sides, "p long, digest binary, right binary, left binary"), "sides")

    def reach(side: str) -> DataFrame:
        rows = sides.select("p", "digest", side).repartitionByRange("p", side).sortWithinPartitions("p", side)
        return rows.mapInArrow(_longest, "digest binary, reach int").withColumnRenamed("reach", side)

    bounds = classes.join(reach("right"), "digest").join(reach("left"), "digest").where(F.col("right") + F.col("left") >= width)
    found = bounds.select("p", "digest", "span", "place", "right", "left", "size").mapInArrow(
        _possible_windows(width), "h long, digest binary, first int, last int, size long"
    )
    found = stored(found, "windows")
    single = found.where("h IS NOT NULL")
    twice = single.groupBy("h").agg(F.sum("size").alias("c")).where("c > 1").select("h")
    alike = single.join(twice, "h", "left_semi").select("digest", "first", "last")
    copies = classes.where("size > 1").select("digest", F.lit(0).alias("first"), (F.length("span") - width).alias("last"))
    every = alike.unionByName(found.where("h IS NULL").select("digest", "first", "last")).unionByName(copies)
    ordered = F.sort_array(F.collect_set(F.struct("first", "last")))
    return every.groupBy("digest").agg(ordered.alias("x")).select("digest", F.col("x.first").alias("first"), F.col("x.last").alias("last"))


def _repeated(classes: DataFrame, width: int) -> DataFrame:
    """(digest, first, last): runs of repeated windows of each class of equal surroundings, counted from its start."""
    sizes = classes.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    large = stored(sizes.where(F.col("c") > GROUP).select("p"), "large")
    bytes_ = 16 * large.count()
    small = classes.join(bounded(large, bytes_), "p", "left_anti").select("p", "digest", "span", "size")
    within = small.repartition("p").sortWithinPartitions("p").mapInArrow(
        _group_windows(width), "digest binary, first array<int>, last array<int>"
    )
    if not bytes_:
        return within
    return within.unionByName(_repeated_in_large(classes.join(bounded(large, bytes_), "p", "left_semi"), width))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of window starts of a row, sorted by their first, joined where they touch or overlap."""
    for batch in batches:
        out: list[list] = [[], []]
        for value in batch.column(1):
            first, last = (x.to_numpy() for x in value.values.flatten())
            reach = np.maximum.accumulate(last)
            new = np.r_[True, first[1:] > reach[:-1] + 1]
            out[0].append(first[new])
            out[1].append(reach[np.r_[new[1:], True]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in out)], names=["_key", "_first", "_last"]
        )


def _cutter(width: int, outline: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, last = (batch.column(i) for i in range(3))
            total, removed, pieces, kept = [], [], [], []
            for i, text in enumerate(texts.to_pylist()):
                data = as_bytes(text)
                gone = np.zeros(len(data), dtype=bool)
                if first[i].is_valid:
                    step = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(step, first[i].values.to_numpy(), 1)
                    np.add.at(step, last[i].values.to_numpy() + width, -1)
                    gone = np.cumsum(step[:-1]) > 0
                total.append(len(data))
                removed.append(int(gone.sum()))
                pieces.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                rest = data[~gone].tobytes() if removed[-1] else data.tobytes()
                kept.append(hashlib.sha256(rest).hexdigest() if outline else rest)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], *(pa.array(x, pa.int64()) for x in (total, removed, pieces)),
                 pa.array(kept, pa.string() if outline else pa.binary())],
                names=[*batch.schema.names[3:], "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return cut


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, batches: int = BATCHES,
    columns: tuple[str, ...] = (), outline: bool = False, batch: Column | None = None,
) -> DataFrame:
    """Removes every byte covered by a string of ``width`` bytes that also starts anywhere else in ``docs``.

    One row per input row: ``id_col``, ``columns``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept``, the remaining bytes (which may cut a character), or with ``outline`` their SHA-256 in hex.
    ``batch`` gives the arrival order (0 .. batches - 1) of a row, by default a hash; the result does not depend on it.

    The index finds the suffixes with a match on their first 24 bytes. Their surroundings (all windows that select
    them) are then compared: equal surroundings form classes, classes that meet in a suffix are compared window by window.

    Null and empty texts have no bytes and stay empty; texts below ``width`` bytes stay. Rows are told apart by id and
    text, so null and repeated ids are allowed; equal rows are copies of each other. No rows in, none out.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), whole_text(text_col).alias("text"), *([batch.alias("b")] if batch is not None else []))
    if batch is None:
        keyed = keyed.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int"))
    index, found = SuffixIndex(width), None
    for i in range(batches):
        matched = index.add(keyed.where(F.col("b") == i).select("key", "text"))
        found = matched if found is None else found.unionByName(matched)
    places = stored(found.groupBy("key").agg(F.collect_set("at").alias("places")), "places")
    size = places.agg(F.coalesce(F.sum(40 + 4 * F.size("places")), F.lit(0))).first()[0]
    around = keyed.select("key", "text").join(bounded(places, size), "key").select("key", "text", "places")
    around = stored(
        around.mapInArrow(_surroundings(width), "p long, digest binary, span binary, key long, lo int, place int"), "surroundings"
    )
    classes = stored(
        around.groupBy("p", "digest").agg(F.count(F.lit(1)).alias("size"), F.first("span").alias("span"), F.first("place").alias("place")), "classes"
    )
    repeated = _repeated(classes, width).where(F.size("first") > 0)
    run = F.expr("transform(arrays_zip(first, last), x -> struct(lo + x.first AS a, lo + x.last AS b))")
    per_row = around.select("digest", "key", "lo").join(repeated, "digest").select("key", F.explode(run).alias("r"))
    cuts = per_row.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_set("r")).alias("runs"))
    cuts = stored(cuts.mapInArrow(_merged, "_key long, _first array<int>, _last array<int>"), "cuts")
    size = cuts.agg(F.coalesce(F.sum(48 + 8 * F.size("_first")), F.lit(0))).first()[0]
    carried = [id_col, *columns]
    rows = docs.select(
        row_key(id_col, text_col).alias("_key"), whole_text(text_col).alias("_text"), *[F.col(c) for c in carried]
    )
    joined = rows.join(bounded(cuts, size), "_key", "left").select("_text", "_first", "_last", *carried)
    schema = T.StructType([joined.schema[c] for c in carried])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("kept", "string" if outline else "binary")
    return joined.mapInArrow(_cutter(width, outline), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, outline=True).withColumnRenamed("kept", "kept_sha256")
