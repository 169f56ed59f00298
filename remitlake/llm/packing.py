"""Packing of tokenised documents into sequences: large-item matching, then best fit of the small ones."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, whole_text
from .tokenizer_cache import cached

CAPACITY, END, TOKENIZER = 2048, 0, "byte_bpe_50k.json"

#: length; ranks [low, high) within the length; first sequence; offset of the first; items of the run per sequence
Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Where the items of each length go, as runs over their ranks, and the number of sequences.

    Works on counts per length only, so its cost and the number of runs depend on ``capacity``, not on the documents.
    Lengths above a third of the capacity are matched greedily: the largest left takes the largest other one that fits,
    so a sequence gets two of them at most. The others, in descending order, go to the sequence with the least room
    that holds them; a new one is opened if none does.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    total = 0
    room: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
    gaps: list[int] = []

    def open_gap(gap: int, base: int, n: int) -> None:
        if gap and n:
            if gap not in room:
                room[gap] = []
                insort(gaps, gap)
            room[gap].append((base, n))

    def place(s: int, n: int, base: int, offset: int, per: int = 1) -> None:
        runs.append((s, used[s], used[s] + n, base, offset, per))
        used[s] += n
        left[s] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        at = bisect_left(large, min(s, capacity - s) + 1) - 1
        t = large[at] if at >= 0 else 0
        if t == s and left[s] < 2:
            at -= 1
            t = large[at] if at >= 0 else 0
        if not t:
            n = left[s] if 2 * s > capacity else 1
            place(s, n, total, 0)
            open_gap(capacity - s, total, n)
        elif t == s:
            n = left[s] // 2
            place(s, n, total, 0)
            place(s, n, total, s)
            open_gap(capacity - 2 * s, total, n)
        else:
            n = min(left[s], left[t])
            place(s, n, total, 0)
            place(t, n, total, s)
            open_gap(capacity - s - t, total, n)
        total += n
        large = [x for x in large if left[x]]

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                n = -(-left[s] // (capacity // s))
                open_gap(capacity, total, n)
                total += n
                continue
            gap = gaps[at]
            base, n = room[gap].pop()
            if not room[gap]:
                del room[gap]
                gaps.pop(at)
            per = gap // s
            full = min(n, left[s] // per)
            if full:
                place(s, full * per, base, capacity - gap, per)
                open_gap(gap - per * s, base, full)
            rest = left[s] if full < n else 0
            if rest:
                place(s, rest, base + full, capacity - gap, per)
                open_gap(gap - rest * s, base + full, 1)
            taken = full + (1 if rest else 0)
            open_gap(gap, base + taken, n - taken)
    return runs, total


def _pieces(tokenizer: str, end: int, capacity: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = cached(tokenizer)
        tail = end.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(t.encode(part.column(1).to_pylist())):
                    ids += tail
                    n, low, k = len(ids) // 4, 0, 0
                    while low < n:
                        high = min(n, low + (n % capacity or capacity if not k else capacity))
                        doc.append(i)
                        piece.append(k)
                        start.append(low)
                        length.append(high - low)
                        crc.append(zlib.crc32(ids[4 * low : 4 * high]))
                        low, k = high, k + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                    names=["doc", "piece", "start", "length", "ids_crc32"],
                )

    return emit


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end: int = END,
) -> DataFrame:
    """Packs the ids of every whole text, each followed by ``end``, into sequences of at most ``capacity`` ids.

    One row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``. Longer
    documents are cut from their end into pieces of ``capacity``, so that only the first may be shorter.

    Documents are encoded once; the plan needs the number of pieces of each length (at most ``capacity`` numbers), and a
    piece finds its place from its rank among the pieces of its length: a count per write task and length gives the
    rank's base, so one length may hold any share of the pieces.

    Null and empty texts are one piece that holds ``end`` alone. Null and repeated ids are packed like others. No rows
    in, none out. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), whole_text(text_col).alias("_text"))
    kind = dict(rows.dtypes)["doc"]
    pieces = rows.mapInArrow(
        _pieces(tokenizer, end, capacity), f"doc {kind}, piece int, start long, length long, ids_crc32 long"
    )
    pieces = stored(
        pieces.withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    places = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 0, 1)], "length long, low long, high long, first long, place long, per long"
    )
    local = F.row_number().over(Window.partitionBy("length", "task").orderBy("row")) - 1
    ranked = pieces.withColumn("local", local).join(bases, ["length", "task"]).withColumn("rank", F.col("local") + F.col("base"))
    step = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(places), "length").where("rank >= low AND rank < high").select(
        F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(step, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
