"""Removal of repeated word windows: anchors at difference-cover positions find matches, which are then extended.

Two equal windows have covered positions at the same offset below the period, so the shorter windows at covered positions,
the anchors, meet. An anchor carries a hash of its surroundings: all words of the windows that hold it within the period.
Anchors with equal surroundings extend as far as any window reaches, so all those windows are settled at once. Only where an
anchor stands in several surroundings, at the edges of matches, are windows compared one by one, one text for each
surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bounded, mix, rolling, row_key, runs, stored, whole_text, word_hashes

WIDTH = 35
#: Every remainder modulo PERIOD is a difference of two members of COVER, so for any two positions some shift below
#: PERIOD moves both onto covered positions.
PERIOD, COVER = 13, (0, 1, 3, 9)
PLAIN, TWICE, SETTLED = range(3)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # splits at the bytes 0x20 and 0x09 to 0x0D


def _covered(n: int) -> np.ndarray:
    """Positions below ``n`` whose remainder is in the cover, ascending."""
    at = (np.arange(0, max(n, 0) + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at < n]


def _surroundings(values: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
    """Hash of the words of all windows that begin at most PERIOD - 1 words before an anchor and end within the text."""
    n, reach = len(values), width + PERIOD - 1
    before = np.minimum(anchors, PERIOD - 1)
    start, end = anchors - before, np.minimum(anchors + width, n)
    full = rolling(values, reach) if n >= reach else np.empty(0, dtype=U64)
    whole = (before == PERIOD - 1) & (end - start == reach)
    out = np.empty(len(anchors), dtype=U64)
    out[whole] = full[start[whole]]
    for i in np.flatnonzero(~whole).tolist():  # near the ends of the text only
        part = rolling(values[start[i] : end[i]], int(end[i] - start[i]))
        out[i] = mix(part ^ U64(int(before[i]) * 1_000_003 + int(end[i] - start[i])))[0]
    return out


def _collapsed(h: np.ndarray, c: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """(h, c, key, code): of entries with equal (h, c) one goes on to meet others, marked TWICE; the rest are settled and
    travel under a hash of their own, so that a hash which many rows share is a few entries by the time it is shuffled."""
    order = np.lexsort((c, h))
    h, c, keys, places = h[order], c[order], keys[order], places[order]
    same = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])] if len(h) else np.empty(0, dtype=bool)
    kind = np.where(same, SETTLED, PLAIN)
    kind[:-1][~same[:-1] & same[1:]] = TWICE
    h = np.where(same, mix(keys.view(U64) ^ (places.astype(U64) << U64(32))), h)
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(keys), pa.array(places * 4 + kind)],
        names=["h", "c", "key", "code"],
    )


_ENTRY = "h long, c long, key long, code long"


def _anchors(width: int):
    """The ``width - PERIOD + 1`` words from covered positions with their surroundings."""
    short = width - PERIOD + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, around, rows, places = [], [], [], []
                for key, text in zip(part.column(0).to_numpy(), part.column(1).to_pylist()):
                    words = words_of(text)
                    if len(words) < width:
                        continue
                    anchor = _covered(len(words) - short + 1)
                    values = word_hashes(words)
                    hashes.append(rolling(values, short)[anchor])
                    around.append(_surroundings(values, anchor, width))
                    rows.append(np.full(len(anchor), key, dtype=np.int64))
                    places.append(anchor.astype(np.int64))
                if hashes:
                    yield _collapsed(*(np.concatenate(x) for x in (hashes, around, rows, places)))

    return emit


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, sure) from entries sorted by (h, c): those that share both with another are sure; of every c under an h
    that has several, one entry is to be compared (not sure). One batch and one entry are held at a time."""
    held: list[np.ndarray] = []
    before: tuple = ()  # hashes of the entry before ``held``
    start: tuple = ()  # the first entry of the last h, and whether it was passed on

    def settled(rows: list[np.ndarray], after: tuple) -> pa.RecordBatch:
        nonlocal before, start
        h, c, key, code = rows
        eh = np.r_[bool(before) and before[0] == h[0], h[1:] == h[:-1]]
        ec = eh & np.r_[bool(before) and before[1] == c[0], c[1:] == c[:-1]]
        next_ = np.r_[ec[1:], bool(after) and after == (h[-1], c[-1])]
        sure = np.flatnonzero(ec | next_ | (code % 4 == TWICE))
        several = eh & ~ec  # a further c under the same h
        begins = np.flatnonzero(~eh)
        firsts = np.searchsorted(begins, np.flatnonzero(several), "right") - 1
        edge = [np.flatnonzero(several), begins[np.unique(firsts[firsts >= 0])]]
        keys, at = [key[sure], *(key[e] for e in edge)], [code[sure], *(code[e] for e in edge)]
        if (firsts < 0).any() and not start[2]:
            keys.append(np.array([start[0]]))
            at.append(np.array([start[1]]))
            start = (*start[:2], True)
        if len(begins):
            last = begins[-1]
            start = (key[last], code[last], bool(several[last:].any()))
        before = (h[-1], c[-1])
        marks = np.zeros(sum(map(len, keys)), dtype=bool)
        marks[: len(sure)] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array((np.concatenate(at) // 4).astype(np.int32)), pa.array(marks)],
            names=["key", "at", "sure"],
        )

    for batch in batches:
        now = [x.to_numpy() for x in batch.columns]
        done = now[3] % 4 == SETTLED
        if done.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(now[2][done]), pa.array((now[3][done] // 4).astype(np.int32)), pa.array(np.ones(done.sum(), dtype=bool))],
                names=["key", "at", "sure"],
            )
            now = [x[~done] for x in now]
        if len(now[0]):
            if held:
                yield settled(held, (now[0][0], now[1][0]))
            held = now
    if held:
        yield settled(held, ())


def _settled(entries: DataFrame) -> DataFrame:
    return entries.repartition("h").sortWithinPartitions("h", "c").mapInArrow(_settle, "key long, at int, sure boolean")


def _windows(width: int):
    """128-bit hashes of the windows that hold an anchor to be compared less than PERIOD words from their start."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found: list[list[np.ndarray]] = [[], [], [], []]
                for i in range(part.num_rows):
                    words = words_of(part.column(1)[i].as_py())
                    anchors = np.array(part.column(2)[i].values.to_numpy(), dtype=np.int64)
                    starts = np.flatnonzero(_starts(anchors, len(words) - width + 1))
                    values = word_hashes(words)
                    found[0].append(rolling(values, width)[starts])
                    found[1].append(rolling(mix(values ^ U64(0x5851F42D4C957F2D)), width)[starts])
                    found[2].append(np.full(len(starts), part.column(0)[i].as_py(), dtype=np.int64))
                    found[3].append(starts)
                if found[0]:
                    yield _collapsed(*(np.concatenate(x) for x in found))

    return emit


def _starts(anchors: np.ndarray, n: int) -> np.ndarray:
    """Mask of the window starts, of ``n``, that have an anchor among the PERIOD words from them."""
    step = np.zeros(max(n, 0) + 1, dtype=np.int64)
    np.add.at(step, np.minimum(np.maximum(anchors - PERIOD + 1, 0), max(n, 0)), 1)
    np.add.at(step, np.minimum(anchors + 1, max(n, 0)), -1)
    return np.cumsum(step[:-1]) > 0


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places as runs [first, last] of window starts; an anchor stands for all starts from PERIOD - 1 before it."""
    for batch in batches:
        out: list[list] = [[], []]
        for anchors, starts in zip(batch.column(1), batch.column(2)):
            some = [np.sort(x.values.to_numpy()) if x.is_valid else np.empty(0, dtype=np.int32) for x in (anchors, starts)]
            one = runs(np.unique(some[1]))
            first = np.concatenate([np.maximum(some[0] - PERIOD + 1, 0), one[0]])
            last = np.concatenate([some[0], one[1]])
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order])
            new = np.r_[True, first[1:] > reach[:-1] + 1]
            out[0].append(first[new])
            out[1].append(reach[np.r_[new[1:], True]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in out)], names=["key", "first", "last"]
        )


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, int]:
    """Runs [first, last] of the starts of windows that also start anywhere else, per row key; and their size in bytes.

    The last run of a text may reach past its last window.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), whole_text(text_col).alias("text"))
    met = stored(_settled(keyed.mapInArrow(_anchors(width), _ENTRY)), "anchors")
    edges = stored(met.where("NOT sure").groupBy("key").agg(F.collect_set("at").alias("places")), "edges")
    size = edges.agg(F.coalesce(F.sum(40 + 4 * F.size("places")), F.lit(0))).first()[0]
    regions = keyed.join(bounded(edges, size), "key").select("key", "text", "places")
    windows = _settled(regions.mapInArrow(_windows(width), _ENTRY)).where("sure")
    sides = met.where("sure").select("key", F.col("at").alias("anchor"), F.lit(None).cast("int").alias("start")).unionByName(
        windows.select("key", F.lit(None).cast("int").alias("anchor"), F.col("at").alias("start"))
    )
    places = sides.groupBy("key").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("start").alias("starts"))
    table = stored(places.mapInArrow(_fold, "key long, first array<int>, last array<int>"), "windows")
    return table, table.agg(F.coalesce(F.sum(48 + 8 * F.size("first")), F.lit(0))).first()[0]


def _cutter(width: int, outline: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, last = (batch.column(i) for i in range(3))
            total, removed, kept = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                words = words_of(text)
                total.append(len(words))
                if first[i].is_valid:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, np.asarray(first[i].values.to_numpy()), 1)
                    np.add.at(step, np.minimum(np.asarray(last[i].values.to_numpy()) + width, len(words)), -1)
                    stay = np.cumsum(step[:-1]) <= 0
                    removed.append(int(len(words) - stay.sum()))
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    removed.append(0)
                rest = b" ".join(words)
                if outline:
                    kept.append(hashlib.sha256(rest).hexdigest())
                else:
                    kept.append(rest.decode("utf-8", "surrogatepass") if removed[-1] else text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=[*batch.schema.names[3:], "n_words", "n_removed", "kept"],
            )

    return cut


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    columns: tuple[str, ...] = (), outline: bool = False,
) -> DataFrame:
    """Removes every word covered by a window of ``width`` words that also starts anywhere else, same text included.

    One row per input row: ``id_col``, ``columns``, ``n_words``, ``n_removed`` and ``kept``, the text that is left (the
    untouched text where nothing is removed, else the kept words joined by one space); with ``outline`` the SHA-256 of
    the kept words joined by one space instead of the text.

    Null, empty and blank texts and those of fewer words have no window and stay. Rows are told apart by id and text, so
    null and repeated ids are allowed; equal rows are copies of each other. Windows of a text that overlap each
    other count as separate. No rows in, none out. Columns named like the results are replaced if not asked for.
    """
    found, size = repeated_windows(docs, id_col, text_col, width)
    carried = [id_col, *columns]
    rows = docs.select(
        row_key(id_col, text_col).alias("_key"), whole_text(text_col).alias("_text"), *[F.col(c) for c in carried]
    )
    side = bounded(found.select(F.col("key").alias("_key"), F.col("first").alias("_first"), F.col("last").alias("_last")), size)
    joined = rows.join(side, "_key", "left").select("_text", "_first", "_last", *carried)
    schema = T.StructType([joined.schema[c] for c in carried])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(_cutter(width, outline), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, outline=True).withColumnRenamed("kept", "kept_sha256")
