"""Alignment of two tokenizers' tokens: one state vector advances through all documents of a batch in lockstep.

Both token sequences of a document spell the same bytes. A pair of pointers walks them like a merge: the token that ends
first lets its pointer advance; where both end together, the two tokens are linked, the text is cut into groups there, and
both pointers advance. The pointers of all documents of a batch are two NumPy vectors, so that a step moves every
document at once; finished documents are compacted away.

A link's tokens end together, so the bytes of one are a suffix of the other's. The two vocabularies alone therefore bound
the number of different id pairs (``possible_pairs``), whatever the corpus: the table of their counts has a proven size.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, stored
from .tokenizer_cache import TokenizerCache

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose documents advance together, and cached words per tokenizer and Python worker.
TOGETHER, CACHE = 2 << 20, 300_000
_MARK = "▁"  # stands for a space in pieces


class ByteTokens:
    """Ids of the byte-level tokenizer, its special tokens' strings taken as plain text, and the bytes of each id."""

    def __init__(self, name: str = A_NAME) -> None:
        self.cache = TokenizerCache(name)
        self.cache.tokenizer.encode_special_tokens = True
        self.cache.added = []
        value = {c: b for b, c in self.cache.characters.items()}
        vocabulary = self.cache.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in value for c in token):
                self.bytes[i] = bytes(value[c] for c in token)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache.known) > CACHE:
            self.cache.known.clear()
        return [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in self.cache.encode([" " + t for t in texts])]


class PieceTokens:
    """Ids of the piece tokenizer, asked once per word, and the bytes of each id.

    No piece holds a space but at its start (or is all spaces) and none a line break, so a text without neighbouring
    spaces is the sequence of its words, each with what stands before it. Other texts go to the library whole.
    """

    def __init__(self, name: str = B_NAME) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.by_words = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_MARK, " ").encode("utf-8", "surrogatepass")
            for i, p in enumerate(pieces)
        ]
        self.space = np.array([self.library.piece_to_id(_MARK)], dtype=np.int32).tobytes()
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, num_threads=1), dtype=np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space or line break it begins with."""
        if word == " ":
            return self.space
        return self._ids(word[1:]) if word[0] == " " else self._ids(word)[4:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, out = self.known, []
        if len(known) > CACHE:
            known.clear()
        for text in texts:
            text = " " + text
            if not self.by_words or "  " in text or "\0" in text:
                out.append(np.frombuffer(self._ids(text[1:]), dtype=np.int32))
                continue
            words = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")[1:]
            for word in words:
                if word not in known:
                    known[word] = self._word(word)
            out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32))
        return out


_tokens: dict[str, ByteTokens | PieceTokens] = {}


def tokens(name: str) -> ByteTokens | PieceTokens:
    """The tokenizer of a file, once per Python worker."""
    if name not in _tokens:
        _tokens[name] = PieceTokens(name) if name.endswith(".model") else ByteTokens(name)
    return _tokens[name]


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together in any text: those where the bytes of one are a suffix of the other's."""
    in_a, in_b = Counter(filter(None, a)), Counter(filter(None, b))
    inside = sum(n * sum(in_b[t[i:]] for i in range(len(t))) for t, n in in_a.items())
    return inside + sum(n * sum(in_a[t[i:]] for i in range(1, len(t))) for t, n in in_b.items())


def lockstep(a_ends: np.ndarray, a_first: np.ndarray, b_ends: np.ndarray, b_first: np.ndarray) -> np.ndarray:
    """Per A token the B token that ends at the same byte of its document, else -1.

    ``*_ends``: byte ends of all documents' tokens, one document after the other; ``*_first``: place of each document's
    first token, and the total. The two sequences of a document end at the same byte.
    """
    link = np.full(len(a_ends), -1, dtype=np.int32)
    at_a, at_b, stop = a_first[:-1].copy(), b_first[:-1].copy(), a_first[1:]
    going = at_a < stop
    at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    while len(at_a):
        x, y = a_ends[at_a], b_ends[at_b]
        together = x == y
        link[at_a[together]] = at_b[together]
        at_a += x <= y
        at_b += y <= x
        going = at_a < stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    return link


def _flat(found: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, where each document's begin, and the byte ends within each document."""
    ids = np.concatenate([*found, np.empty(0, dtype=np.int32)])
    first = np.cumsum([0, *map(len, found)], dtype=np.int32)
    total = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(lengths[ids], out=total[1:])
    return ids, first, (total[1:] - np.repeat(total[first[:-1]], np.diff(first))).astype(np.int32)


class Aligner:
    """Aligned documents of one batch: ids of both sides, links as places of linked tokens."""

    def __init__(self, a_name: str, b_name: str) -> None:
        self.a, self.b = tokens(a_name), tokens(b_name)
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t.bytes], dtype=np.int32) for t in (self.a, self.b))
        self._names: list[str] = []

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both sides' ids of each text; none where the text is null or empty or a side does not spell space + text."""
        none = np.empty(0, dtype=np.int32)
        some = [t for t in texts if t]
        sides = iter(zip(some, self.a.encode(some), self.b.encode(some)))
        out: tuple[list, list] = ([], [])
        for text in texts:
            one, two = none, none
            if text:
                _, one, two = next(sides)
                raw = (" " + text).encode("utf-8", "surrogatepass")
                spelt = (b"".join(map(t.bytes.__getitem__, x.tolist())) for t, x in ((self.a, one), (self.b, two)))
                if not all(s == raw for s in spelt):
                    one, two = none, none
            out[0].append(one)
            out[1].append(two)
        return out

    def names(self) -> list[str]:
        """Text of A ids then B ids, each followed by a comma, and by the sign that closes its part of a group."""
        if not self._names:
            for side, sign in ((self.a, "|"), (self.b, ";")):
                for i in range(len(side.bytes)):
                    self._names += (f"{i},", f"{i}{sign}")
        return self._names

    def run(self, texts: list[str | None]):
        a, b = self.ids(texts)
        a_ids, a_first, a_ends = _flat(a, self.a_lengths)
        b_ids, b_first, b_ends = _flat(b, self.b_lengths)
        link = lockstep(a_ends, a_first, b_ends, b_first)
        return a_ids, a_first, b_ids, b_first, link

    def group_texts(self, a_ids, a_first, b_ids, b_first, link) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        cut_a = np.flatnonzero(link >= 0).astype(np.int32)
        cut_b = link[cut_a]
        shut_a, shut_b = np.zeros(len(a_ids), dtype=np.int32), np.zeros(len(b_ids), dtype=np.int32)
        shut_a[cut_a] = shut_b[cut_b] = 1
        sequence = np.empty(len(a_ids) + len(b_ids), dtype=np.int32)
        # A token follows the B tokens of all groups before its own, a B token the A tokens up to its own group's.
        before = np.concatenate([[0], cut_b + 1])[np.cumsum(shut_a) - shut_a]
        sequence[np.arange(len(a_ids)) + before] = 2 * a_ids + shut_a
        before = np.concatenate([cut_a + 1, [len(a_ids)]])[np.cumsum(shut_b) - shut_b]
        sequence[np.arange(len(b_ids)) + before] = 2 * (len(self.a.bytes) + b_ids) + shut_b
        names, first = self.names(), (a_first + b_first).tolist()
        return ["".join(map(names.__getitem__, sequence[lo:hi].tolist()))[:-1] for lo, hi in zip(first, first[1:])]


def _align(a_name: str, b_name: str, outline: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_name, b_name)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                part = batch.slice(at, max(1, int(np.searchsorted(sizes, before + TOGETHER, "right")) - at))
                at += part.num_rows
                found = aligner.run(part.column(0).to_pylist())
                a_ids, a_first, b_ids, b_first, link = found
                linked = np.flatnonzero(link >= 0)
                cuts = np.searchsorted(linked, a_first)
                n_links = pa.array(np.diff(cuts), pa.int64())
                columns = {"n_a": pa.array(np.diff(a_first), pa.int64()), "n_b": pa.array(np.diff(b_first), pa.int64()), "n_groups": n_links, "n_links": n_links}
                if outline:
                    texts = aligner.group_texts(*found)
                    columns["groups_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts])
                else:
                    starts = np.repeat(a_first[:-1], np.diff(cuts)), np.repeat(b_first[:-1], np.diff(cuts))
                    for name, values, first in (
                        ("a_ids", a_ids, a_first), ("b_ids", b_ids, b_first),
                        ("link_a", linked - starts[0], cuts), ("link_b", link[linked] - starts[1], cuts),
                    ):
                        offsets, values = pa.array(first, pa.int32()), pa.array(values, pa.int32())
                        columns[name] = pa.ListArray.from_arrays(offsets, values)
                code = a_ids[linked].astype(np.int64) << 32 | b_ids[link[linked]]
                each = [np.unique(code[lo:hi], return_counts=True) for lo, hi in zip(cuts.tolist(), cuts[1:].tolist())]
                first = pa.array(np.r_[0, np.cumsum([len(p) for p, _ in each])], pa.int32())
                for name, kind, which in (("pairs", pa.int64(), 0), ("times", pa.int32(), 1)):
                    values = np.concatenate([e[which] for e in each])
                    columns[name] = pa.ListArray.from_arrays(first, pa.array(values, kind))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns.values()], names=[*part.schema.names[1:], *columns])

    return emit


_COUNTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long"}
_PAIRS = {"pairs": "array<long>", "times": "array<int>"}


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = (), outline: bool = False,
    a_name: str = A_NAME, b_name: str = B_NAME,
) -> DataFrame:
    """Per row ``id_col``, ``columns``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, and the alignment: ``a_ids``, ``b_ids``
    and the linked tokens' places ``link_a``, ``link_b`` (a group ends with each), or with ``outline`` the SHA-256 of its
    text; last ``pairs`` (A id * 2^32 + B id) and ``times``, the document's id pairs and how often it links them.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros, empty arrays,
    an empty digest. Equal rows have equal results. No rows in, none out. ``columns`` named like the results are refused.
    """
    shape = {"groups_sha256": "string"} if outline else dict.fromkeys(("a_ids", "b_ids", "link_a", "link_b"), "array<int>")
    result = {**_COUNTS, **shape, **_PAIRS}
    carried = [id_col, *dict.fromkeys(c for c in columns if c != id_col)]
    if set(result) & set(carried):
        raise ValueError(f"columns named like results: {sorted(set(result) & set(carried))}")
    texts = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in carried])
    schema = T.StructType([texts.schema[c] for c in carried])
    for name, kind in result.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return texts.mapInArrow(_align(a_name, b_name, outline), schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of all rows hold the pair, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = (),
    a_name: str = A_NAME, b_name: str = B_NAME,
) -> DataFrame:
    """The outline of ``align`` per row with ``n_best`` (links whose pair has its B id's highest count) and ``count_sum``
    (the links' counts added up), both zero without tokens. Counts are over all rows of ``docs``."""
    if "_row" in (id_col, text_col, *columns):
        raise ValueError("columns named like results: ['_row']")
    named = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = stored(align(named, id_col, text_col, ("_row", *columns), True, a_name, b_name), "aligned")
    counts = stored(pair_counts(rows), "counts")
    size = 48 * min(possible_pairs(tokens(a_name).bytes, tokens(b_name).bytes), counts.count())
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), "x.times")
    sums = each.join(bounded(counts, size), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    shown = [c for c in rows.columns if c not in ("_row", *_PAIRS)]
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop(*_PAIRS).join(sums, "_row", "left").select(*[F.col(f"`{c}`") for c in shown], *zero)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
