"""Byte-level BPE: token boundaries from a scan of transition functions, merges from ranks, decoding with offsets."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

RANKS = "byte_bpe_50k.tiktoken"
#: Cached pieces per Python worker; beyond it the cache starts anew, so memory is bounded.
CACHE = 400_000

# Symbols of the automaton. A white-space character is "last" if a visible character follows it.
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, SHORT_END, LONG_END = range(8)
# States: which token the last character left open. PREFIX: a single space that the next run takes along; TWO, ONE:
# letters a contraction still has to take; CLOSED: none.
IN_LETTERS, IN_NUMBERS, IN_OTHER, PREFIX, IN_WHITE, ONE, TWO, CLOSED = range(8)


def _step(state: int, symbol: int) -> int:
    if symbol == LETTER:
        return {ONE: CLOSED, TWO: ONE}.get(state, IN_LETTERS)
    if symbol in (SHORT_END, LONG_END) and state not in (IN_OTHER, PREFIX):
        return ONE if symbol == SHORT_END else TWO
    return {NUMBER: IN_NUMBERS, SPACE_LAST: PREFIX, WHITE_LAST: CLOSED, WHITE: IN_WHITE}.get(symbol, IN_OTHER)


def _begins(state: int, symbol: int) -> bool:
    """Whether a token begins at a character, given the state before it."""
    if symbol in (SPACE_LAST, WHITE_LAST):
        return True
    if symbol == WHITE:
        return state != IN_WHITE
    if state == PREFIX:
        return False
    if symbol == LETTER:
        return state not in (IN_LETTERS, ONE, TWO)
    return state != (IN_NUMBERS if symbol == NUMBER else IN_OTHER)


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbols' transition functions: their composition table, their values, and the numbers
    of the first ones (symbol s; symbol s at the start of a text)."""
    first = [tuple(_step(q, s) for q in range(8)) for s in range(8)] + [(_step(CLOSED, s),) * 8 for s in range(8)]
    functions, number = [], {}
    todo = list(first)
    while todo:
        f = todo.pop(0)
        if f not in number:
            number[f] = len(functions)
            functions.append(f)
            todo.extend(tuple(g[q] for q in f) for g in first)
    values = np.array(functions, dtype=np.uint8)
    table = np.array([[number[tuple(g[q] for q in f)] for g in functions] for f in functions], dtype=np.uint8)
    assert len(functions) <= 256
    return table, values, np.array([number[f] for f in first], dtype=np.uint8)


COMPOSE, VALUES, FIRST = _closure()
BEGINS = np.array([[_begins(q, s) for s in range(8)] for q in range(8)])


def scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive scan under composition: rows of ``width`` are scanned side by side, then the rows' totals likewise."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = COMPOSE[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, dtype=np.uint8)
    padded[:n] = functions
    table, size = COMPOSE.ravel(), len(COMPOSE)
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    for i in range(1, width):
        columns[i] = table[columns[i - 1].astype(np.int32) * size + columns[i]]
    before = scan(columns[-1], width)[:-1]
    columns[:, 1:] = table[before.astype(np.int32) * size + columns[:, 1:]]
    return np.ascontiguousarray(columns.T).ravel()[:n]


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point."""
    if not _classes:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = LETTER if kind == "L" else NUMBER
        white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[white] = WHITE
        _classes.append(table)
    return _classes[0]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, the code-point positions where a token begins, and how many tokens each text has."""
    joined = "".join(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    n = len(joined)
    if not n:
        return joined, np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[lengths > 0]
    symbol = classes()[points]
    white = symbol == WHITE
    last = np.zeros(n, dtype=bool)
    last[:-1] = white[:-1] & ~white[1:]
    last[ends[lengths > 0] - 1] = False
    symbol[last] = WHITE_LAST
    symbol[last & (points == 32)] = SPACE_LAST
    quote = np.flatnonzero(points == 39)
    if len(quote):
        left = ends[np.searchsorted(ends, quote, side="right")] - quote - 1
        one = np.where(left >= 1, points[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(left >= 2, points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[quote[short]] = SHORT_END
        symbol[quote[long]] = LONG_END
    functions = FIRST[symbol]
    functions[starts] = FIRST[symbol[starts] + 8]
    state = VALUES[scan(functions), CLOSED]
    before = np.empty(n, dtype=np.uint8)
    before[0] = CLOSED
    before[1:] = state[:-1]
    before[starts] = CLOSED
    begins = BEGINS.ravel()[before * 8 + symbol]
    at = np.flatnonzero(begins)
    return joined, at, np.diff(np.searchsorted(at, np.r_[0, ends]))


class Encoder(dict):
    """Cache from a piece of text to its ids; a missing piece is merged by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.decimals = [str(i) for i in range(len(self.pieces))]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Joins the neighbours of least rank (the leftmost of equals) until no pair is in the vocabulary."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 100:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        ranks, n = self.ranks, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a and a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, b"", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [ranks[p] for p in parts if p]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        joined, at, counts = boundaries(texts)
        places = at.tolist()
        slices = [joined[a:b] for a, b in zip(places, [*places[1:], len(joined)])]
        end = 0
        for count in counts.tolist():
            end += count
            yield list(chain.from_iterable(map(self.__getitem__, slices[end - count : end])))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a rank file, read once per Python worker."""
    if path not in _encoders:
        with open(path, "rb") as lines:
            _encoders[path] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
    return _encoders[path]


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Ids of every whole text and the byte offset at which each token starts: ``id_col``, ``ids``, ``offsets``.

    One row per input row, in any order of ids, with repeats and nulls as they are; null and empty texts have no id.
    ``ranks`` is a rank file of the tokenizer package, found on every machine. Pieces of any length are merged.
    """
    path = public_tokenizers.path(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = list(e.encode(part.column(1).to_pylist()))
                starts = [np.cumsum(e.lengths[x]) - e.lengths[x] if x else [] for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64()))],
                    names=[id_col, "ids", "offsets"],
                )

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(work, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>, offsets array<bigint>")


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """The bytes that ``ids`` stand for: ``id_col``, ``decoded``. Null ids give no byte."""
    path = public_tokenizers.path(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [e.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=[id_col, "decoded"])

    rows = encoded.select(F.col(id_col), "ids")
    return rows.mapInArrow(work, f"`{id_col}` {dict(rows.dtypes)[id_col]}, decoded binary")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """The round trip in one pass: number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes decoded from them."""
    path = public_tokenizers.path(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, of_ids, of_bytes = [], [], []
                for ids in e.encode(part.column(1).to_pylist()):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(e.decimals.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(e.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("_text"))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(work, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
