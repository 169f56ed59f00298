"""Repair of conversation structure as lightest derivations over a weighted hypergraph.

An item (i, state) says that the first i rows are repaired and the roles so far end in ``state`` of the pattern
``(s?(ua)+)?``. A deduction joins an item and a row (kept, given another role, deleted), or an item alone (a turn inserted),
to the next item. Its weight is the sum of costs and the audit, the string of edits, appended; weights compare by cost, then
audit. Both only grow along a deduction, so items pop off the agenda in the order of their final weights (Knuth's
generalisation of Dijkstra's method), until the goal has its own. Two audits of equal cost over the same rows are never
prefixes of each other (the longer holds one more insertion, which costs), so what follows doesn't change their order.

Rows are range-partitioned by conversation and turn, so a conversation of any size spreads over partitions. Those
that lie inside one partition are repaired there. Others become segments of bounded size: each yields the lightest
derivation from every state to every state, these are chained per conversation, and the segments' turns follow from
the chain.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern by the last role written: none, s, u, a. The pattern may end in ENDS.
STATES, ENDS = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only role that can be inserted or given in a state.
ROLE = {q: role for q, role in enumerate(("user", "user", "assistant", "user"))}
LEGAL = frozenset(("su", "ua", "au"))
WHITE = " \t\n\x0b\x0c\r"
#: A conversation's rows leave a task in segments of at most this many rows and about this many characters.
SEGMENT, CHARACTERS = 1024, 8 << 20
GONE, SOUND, BLANK, CUT = range(4)

Weight = tuple[int, str]
Edge = tuple[tuple[int, ...], int, int, str]


def lightest(edges: list[Edge], facts: list[int], goals: list[int]) -> dict[int, Weight]:
    """Lightest weights of the goals that have a derivation.

    An edge holds the items it needs, the item it yields, its cost and its letter; ``facts`` hold at no cost.
    """
    missing = [len(needs) for needs, *_ in edges]
    uses: dict[int, list[int]] = {}
    for e, (needs, *_) in enumerate(edges):
        for item in needs:
            uses.setdefault(item, []).append(e)
    agenda: list[tuple[Weight, int]] = [((0, ""), f) for f in facts]
    heapq.heapify(agenda)
    final: dict[int, Weight] = {}
    wanted = set(goals)
    while agenda and wanted:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        wanted.discard(item)
        for e in uses.get(item, ()):
            missing[e] -= 1
            if not missing[e]:
                needs, head, cost, letter = edges[e]
                if head not in final:
                    had = [final[n] for n in needs]
                    heapq.heappush(agenda, ((sum(h[0] for h in had) + cost, "".join([h[1] for h in had]) + letter), head))
    return {g: final[g] for g in goals if g in final}


def _edges(symbols: str) -> list[Edge]:
    """The deductions over rows given by one sign each: d must go; else the role's initial or x, a capital if truncated.

    Item ``4 i + q`` is (i, q), row i is item ``-1 - i``.
    """
    edges: list[Edge] = []
    for i in range(len(symbols) + 1):
        for q in range(STATES):
            edges.append(((4 * i + q,), 4 * i + NEXT[q, ROLE[q][0]], INSERT, "I"))
    for i, sign in enumerate(symbols):
        row, initial, extra = -1 - i, sign.lower(), TRUNCATED if sign.isupper() else 0
        for q in range(STATES):
            edges.append(((4 * i + q, row), 4 * i + 4 + q, DELETE, "D"))
            if sign != "d":
                edges.append(((4 * i + q, row), 4 * i + 4 + NEXT[q, ROLE[q][0]], REROLE + extra, "R"))
                if (q, initial) in NEXT:
                    edges.append(((4 * i + q, row), 4 * i + 4 + NEXT[q, initial], KEEP + extra, "K"))
    return edges


@functools.lru_cache(maxsize=50_000)
def cheapest(symbols: str) -> Weight:
    """Cost and audit of the cheapest edits that make the whole pattern."""
    n = len(symbols)
    goal = 4 * n + 4
    edges = _edges(symbols) + [((4 * n + q,), goal, 0, "") for q in ENDS]
    return lightest(edges, [0, *(-1 - i for i in range(n))], [goal])[goal]


def crossings(symbols: str) -> list[list[Weight | None]]:
    """Cost and audit of the cheapest edits from every state to every state."""
    edges, rows = _edges(symbols), [-1 - i for i in range(len(symbols))]
    ends = [4 * len(symbols) + q for q in range(STATES)]
    found = [lightest(edges, [q, *rows], ends) for q in range(STATES)]
    return [[f.get(e) for e in ends] for f in found]


def edited(roles: list[str], texts: list[str], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """The turns that the edits leave, entering the pattern in ``state``."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            turn = (ROLE[state], "")
        else:
            turn = (roles[i] if letter == "K" else ROLE[state], texts[i])
            i += 1
        if letter != "D":
            state = NEXT[state, turn[0][:1]]
            out.append(turn)
    return out


def digest_lines(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join([f"{role}:{text}" for role, text in turns]).encode("utf-8", "surrogatepass")


def _symbol(role: str, state: int, copy: bool) -> str:
    if state == BLANK or copy:
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if state == CUT else initial


def _faults(roles: list[str], states: list[int], copies: list[bool]) -> tuple[int, int, int, int]:
    """Blank, duplicate, truncated rows by their first fault, and neighbours whose roles may not follow each other."""
    blank = states.count(BLANK)
    duplicate = sum(c and s != BLANK for c, s in zip(copies, states))
    truncated = sum(s == CUT and not c for c, s in zip(copies, states))
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
    return blank, duplicate, truncated, illegal


def _gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULTS = (*COUNTS, "audit", "repaired_sha256")
_ROWS = {"turns": "array<long>", "roles": "array<string>", "texts": "array<string>", "states": "array<int>"}
_WHOLE = {**dict.fromkeys(COUNTS, "long"), "audit": "string", "repaired_sha256": "string"}
_FIRST = {"part": "int", "at": "int", **_WHOLE, **_ROWS}


def _schema(key: T.StructField, *columns: dict[str, str]) -> T.StructType:
    schema = T.StructType([key])
    for some in columns:
        for name, kind in some.items():
            schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


class _Out:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, key: pa.DataType, columns: dict[str, str]) -> None:
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
                 "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
        self.names = ["_id", *columns]
        self.kinds = [key, *(kinds[k] for k in columns.values())]
        self.rows: list[tuple] = []
        self.weight = 0

    def add(self, row: tuple, weight: int) -> None:
        self.rows.append(row)
        self.weight += weight + 64

    def full(self) -> bool:
        return self.weight > CHARACTERS

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.names)
        self.rows, self.weight = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.kinds)], names=self.names)


def _read(texts_too: bool, segment: int):
    """Repairs the conversations that begin and end within a partition; passes on the others' rows in segments."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at = TaskContext.get().partitionId(), None, 0
        now: object = None
        held: list[list] = [[], [], [], []]
        size, open_, begun = 0, True, False  # the first conversation may have begun in the partition before

        def passed_on() -> None:
            nonlocal at, size, held, open_
            out.add((now, part, at, *[None] * len(_WHOLE), *held), size)
            at, size, open_ = at + 1, 0, True
            held = [[], [], [], []]

        def closed() -> None:
            nonlocal size, held
            turns, roles, texts, states = held
            seen: set[tuple[str, str]] = set()
            copies = []
            for pair in zip(roles, texts):
                copies.append(pair in seen)
                seen.add(pair)
            cost, audit = cheapest("".join(map(_symbol, roles, states, copies)))
            left = edited(roles, texts, audit)
            row = (_gaps(turns), *_faults(roles, states, copies), cost, audit, hashlib.sha256(digest_lines(left)).hexdigest())
            shown = (None, [r for r, _ in left], [t for _, t in left], None) if texts_too else (None,) * 4
            out.add((now, None, None, *row, *shown), len(audit) + 200 + (size if texts_too else 0))
            size, held = 0, [[], [], [], []]

        for batch in batches:
            out = out or _Out(batch.schema.types[0], _FIRST)
            for key, turn, role, text, state in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and key != now:
                    passed_on() if open_ else closed()
                    open_ = False
                now, begun = key, True
                if state != GONE:
                    for column, value in zip(held, (turn, role, text, state)):
                        column.append(value)
                    size += len(role) + len(text)
                    if len(held[0]) >= segment or size > CHARACTERS:
                        passed_on()
                if out.full():
                    yield out.batch()
        if begun:
            passed_on()  # the last one may go on in the next partition
            yield out.batch()

    return emit


_CROSS = {
    "part": "int", "at": "int", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long",
    "low": "long", "high": "long", "different": "long", "initials": "string", "n": "long",
    "costs": "array<long>", "audits": "array<string>",
}


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment its counts, its lowest and highest turn, its first and last role, and its crossings."""
    for batch in batches:
        out = _Out(batch.schema.types[0], _CROSS)
        for key, part, at, turns, roles, states, places in zip(*(c.to_pylist() for c in batch.columns)):
            gone = set(places or ())
            copies = [i in gone for i in range(len(roles))]
            known = [t for t in turns if t is not None]
            ways = [w for row in crossings("".join(map(_symbol, roles, states, copies))) for w in row]
            ends = (roles[0][:1].ljust(1, "-") + roles[-1][:1].ljust(1, "-")) if roles else ""
            out.add(
                (key, part, at, *_faults(roles, states, copies), min(known, default=None), max(known, default=None),
                 len(set(known)), ends, len(roles), [w and w[0] for w in ways], [w and w[1] for w in ways]),
                16 * len(roles),
            )
        yield out.batch()


_CHAIN = {**_WHOLE, "parts": "array<int>", "ats": "array<int>", "enters": "array<int>", "leaves": "array<int>", "starts": "array<long>"}


class Chain:
    """Segments of one conversation in order; per boundary and state the lightest way there, as a link to the one before."""

    def __init__(self) -> None:
        self.counts = [0] * 4
        self.low = self.high = None
        self.different = 0
        self.last = ""
        self.costs: list[int | None] = [0, None, None, None]
        self.steps: list[list[tuple[int, str] | None]] = []  # per segment and state: state before, audit of the segment
        self.names: list[tuple[int, int]] = []

    def _smaller(self, one: tuple[int, str], two: tuple[int, str]) -> bool:
        """Whether the audit over all segments that ends with ``one`` comes first: compared from where the ways part."""
        (p, a), (q, b) = one, two
        tails = [[a], [b]]
        for step in reversed(self.steps):
            if p == q:
                break
            tails[0].append(step[p][1])
            tails[1].append(step[q][1])
            p, q = step[p][0], step[q][0]
        return "".join(reversed(tails[0])) < "".join(reversed(tails[1]))

    def add(self, row: dict) -> None:
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[name]
        if row["initials"]:
            self.counts[3] += bool(self.last) and self.last + row["initials"][0] not in LEGAL
            self.last = row["initials"][1]
        if row["low"] is not None:
            self.different += row["different"] - (self.high == row["low"])
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        costs: list[int | None] = [None] * STATES
        step: list[tuple[int, str] | None] = [None] * STATES
        for leave in range(STATES):
            for enter in range(STATES):
                way = row["costs"][STATES * enter + leave]
                if way is None or self.costs[enter] is None:
                    continue
                cost, link = self.costs[enter] + way, (enter, row["audits"][STATES * enter + leave])
                if step[leave] is None or cost < costs[leave] or cost == costs[leave] and self._smaller(link, step[leave]):
                    costs[leave], step[leave] = cost, link
        self.costs = costs
        self.steps.append(step)
        self.names.append((row["part"], row["at"]))

    def result(self) -> tuple:
        state = None
        for q in ENDS:
            if self.costs[q] is not None:
                better = state is None or self.costs[q] < self.costs[state]
                if better or self.costs[q] == self.costs[state] and self._smaller((q, ""), (state, "")):
                    state = q
        cost = self.costs[state]
        enters, leaves, audits = [], [], []
        for step in reversed(self.steps):
            leaves.append(state)
            state, audit = step[state]
            enters.append(state)
            audits.append(audit)
        audits.reverse()
        kept = [len(a) - a.count("D") for a in audits]
        starts = [0, *np.cumsum(kept, dtype=np.int64).tolist()][:-1]
        gaps = self.high - self.low + 1 - self.different if self.low is not None else 0
        parts, ats = zip(*self.names)
        return (gaps, *self.counts, cost, "".join(audits), None, list(parts), list(ats), enters[::-1], leaves[::-1], starts)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its segments, which arrive in order."""
    out, chain, now = None, None, None
    for batch in batches:
        out = out or _Out(batch.schema.types[0], _CHAIN)
        for row in batch.to_pylist():
            if chain is not None and row["_id"] != now:
                out.add((now, *chain.result()), 200)
                chain = None
            chain, now = chain or Chain(), row["_id"]
            chain.add(row)
        if out.full() or len(out.rows) > 1000:
            yield out.batch()
    if chain is not None:
        out.add((now, *chain.result()), 200)
        yield out.batch()


_PIECE = {"part": "int", "at": "int", "start": "long", "roles": "array<string>", "texts": "array<string>"}


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that a segment leaves on the chosen way through it."""
    for batch in batches:
        out = _Out(batch.schema.types[0], _PIECE)
        for key, part, at, roles, texts, states, places, enter, leave, start in zip(*(c.to_pylist() for c in batch.columns)):
            gone = set(places or ())
            symbols = "".join(_symbol(r, s, i in gone) for i, (r, s) in enumerate(zip(roles, states)))
            left = edited(roles, texts, crossings(symbols)[enter][leave][1], enter)
            out.add((key, part, at, start, [r for r, _ in left], [t for _, t in left]), sum(map(len, texts)))
            if out.full():
                yield out.batch()
        yield out.batch()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a conversation's lines, read piece by piece in order; nothing but the running hash is held."""
    out, running, now, lines = None, None, None, False
    for batch in batches:
        out = out or _Out(batch.schema.types[0], {"digest": "string"})
        for key, roles, texts in zip(*(batch.column(n).to_pylist() for n in ("_id", "roles", "texts"))):
            if running is None or key != now:
                if running is not None:
                    out.add((now, running.hexdigest()), 64)
                running, now, lines = hashlib.sha256(), key, False
            if roles:
                running.update((b"\n" if lines else b"") + digest_lines(list(zip(roles, texts))))
                lines = True
        if len(out.rows) > 1000:
            yield out.batch()
    if running is not None:
        out.add((now, running.hexdigest()), 64)
        yield out.batch()


def _key(name: str = "_id") -> Column:
    """A conversation's id as text that also names the null."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(name).cast("string")))


def _repeats(segments: DataFrame) -> DataFrame:
    """Per segment the places of rows whose role and text stand earlier in the conversation."""
    turn = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")
    rows = segments.select("conv", F.struct("part", "at").alias("segment"), turn)
    digest = F.md5(F.concat(F.length("row.roles").cast("string"), F.lit(":"), F.col("row.roles"), F.col("row.texts")))
    rows = rows.select("conv", "segment", "place", digest.alias("digest"))
    first = rows.groupBy("conv", "digest").agg(F.min(F.struct("segment", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").select("conv", "digest", "first"), "repeats")
    later = rows.join(bounded(first, 128 * first.count()), ["conv", "digest"]).where(F.struct("segment", "place") > F.col("first"))
    return later.groupBy("conv", "segment.part", "segment.at").agg(F.collect_list("place").alias("places"))


def _solved(rows: DataFrame, id_col: str, texts_too: bool, segment: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Conversations that lay within a partition; the others' chains, their pieces and the digests of these."""
    first = rows.repartitionByRange("_id", "_turn", "_tie", "_salt").sortWithinPartitions("_id", "_turn", "_tie", "_salt")
    first = first.select("_id", "_turn", "_role", "_text", "_state")
    id_field = first.schema["_id"]
    first = stored(first.mapInArrow(_read(texts_too, segment), _schema(id_field, _FIRST)), "conversations")
    whole, segments = first.where("at IS NULL"), first.where("at IS NOT NULL").withColumn("conv", _key())
    repeats = stored(_repeats(segments), "places")
    size = repeats.agg(F.coalesce(F.sum(64 + 4 * F.size("places")), F.lit(0))).first()[0]
    marked = segments.join(bounded(repeats, size), ["conv", "part", "at"], "left")
    crossed = marked.select("_id", "part", "at", "turns", "roles", "states", "places").mapInArrow(_cross, _schema(id_field, _CROSS))
    ordered = crossed.repartition("_id").sortWithinPartitions("_id", "part", "at")
    chains = stored(ordered.mapInArrow(_fold, _schema(id_field, _CHAIN)), "chains")
    zipped = F.explode(F.arrays_zip("parts", "ats", "enters", "leaves", "starts")).alias("x")
    ways = chains.select(_key().alias("conv"), zipped).select(
        "conv", F.col("x.parts").alias("part"), F.col("x.ats").alias("at"), F.col("x.enters").alias("enter"),
        F.col("x.leaves").alias("leave"), F.col("x.starts").alias("start"),
    )
    chosen = marked.join(ways, ["conv", "part", "at"])
    pieces = chosen.select("_id", "part", "at", "roles", "texts", "states", "places", "enter", "leave", "start").mapInArrow(
        _apply, _schema(id_field, _PIECE)
    )
    digests = pieces.repartition("_id").sortWithinPartitions("_id", "part", "at").mapInArrow(
        _hash, _schema(id_field, {"digest": "string"})
    )
    return whole, chains, pieces, digests


def _prepared(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    lost = gone if gone is not None else F.lit(False)
    end = F.rtrim(F.col("_text"), F.lit(WHITE))
    state = (
        F.when(F.col("_gone"), GONE).when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    )
    named = rows.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{turn_col}`").cast("long").alias("_turn"), role.alias("_role"),
        F.when(lost, F.lit("")).otherwise(text).alias("_text"), lost.alias("_gone"), F.monotonically_increasing_id().alias("_salt"),
    )
    return named.withColumns({"_tie": F.xxhash64("_role", "_text"), "_state": state.cast("int")})


def repair(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    gone: Column | None = None, segment: int = SEGMENT,
) -> DataFrame:
    """One row per id: ``id_col``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``, the digest of the repaired ``role:text`` lines.

    A row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier), truncated
    (last character not ``.!?``). Edits: K keeps (0), R gives the role user or assistant (1), D deletes (2; blank and
    duplicate rows must go), I inserts an empty turn of user or assistant (5); a truncated row that stays adds 5. The audit
    is the ASCII-least of the cheapest. ``gaps``: turns missing between the lowest and the highest. ``illegal``:
    neighbours before the repair whose roles' initials aren't su, ua or au.

    Rows are taken by turn, nulls first; rows of equal turn by a hash of role and text. Null roles and texts are one space;
    null ids are one conversation, whose null turns count for no gap. Rows for which ``gone`` holds are left out, but their
    conversation is not: without rows it has zeros, an empty audit and the digest of nothing. Repeated rows are
    duplicates. No rows in, none out. Other columns are not looked at.
    """
    prepared = _prepared(rows, id_col, turn_col, role_col, text_col, gone)
    whole, chains, _, digests = _solved(prepared, id_col, False, segment)
    hashed = digests.select(_key().alias("conv"), "digest")
    joined = chains.withColumn("conv", _key()).join(hashed, "conv").withColumn("repaired_sha256", F.col("digest"))
    found = whole.select("_id", *RESULTS).unionByName(joined.select("_id", *RESULTS))
    return found.withColumnRenamed("_id", id_col)


def repaired_turns(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    gone: Column | None = None, segment: int = SEGMENT,
) -> DataFrame:
    """The repaired conversations, one row per turn: ``id_col``, ``turn`` (from 0), ``role``, ``text``. Cases as in ``repair``."""
    prepared = _prepared(rows, id_col, turn_col, role_col, text_col, gone)
    whole, _, pieces, _ = _solved(prepared, id_col, True, segment)
    parts = whole.select("_id", F.lit(0).cast("long").alias("start"), "roles", "texts").unionByName(
        pieces.select("_id", "start", "roles", "texts")
    )
    turns = parts.select("_id", "start", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    return turns.select(F.col("_id").alias(id_col), (F.col("start") + F.col("i")).alias("turn"), F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20, nulls as one space: 0 is lost (``gone``), 1 loses its text, 2 its
    ``.!?``, 3 comes twice, 4 has the role user."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return fault.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(times).alias("copy"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone=F.col("gone"))
