"""Conversation repair against a plain search over whole edit strings."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from remitlake.llm import conversations as c

R = random.Random(12)
SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string, part int, `a b` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 8, "y") for r in rows], SCHEMA).repartition(5)


def next_state(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def plain_repair(rows):
    """(cost, audit, turns) of the least (cost, audit), by keeping for every state the least whole edit string."""
    seen, best = set(), {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    then = next_state(state, role[0])
                    way = (cost + 5, audit + "I", (*turns, (role, "")))
                    if then and (then not in best or way < best[then]):
                        best[then] = way
        return best

    counts = collections.Counter()
    best = inserted(best)
    for role, text in rows:
        shown = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        after = {}
        for state, (cost, audit, turns) in best.items():
            ways = [(state, cost + 2, "D", turns)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways.append((next_state(state, role[:1]), cost + more, "K", (*turns, (role, text))))
                ways += [(next_state(state, r[0]), cost + more + 1, "R", (*turns, (r, text))) for r in ("user", "assistant")]
            for then, price, letter, left in ways:
                way = (price, audit + letter, left)
                if then is not None and (then not in after or way < after[then]):
                    after[then] = way
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best), counts


def plain(rows, order=None):
    """Expected results per conversation; ``rows``: (conv, turn, role, text, gone)."""
    found = collections.Counter()
    for conv in {r[0] for r in rows}:
        held = [(t, r or " " if r is None else r, " " if x is None else x) for k, t, r, x, gone in rows if k == conv and not gone]
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, order[x[1:]] if order else 0))
        known = [t for t, *_ in held if t is not None]
        (cost, audit, turns), counts = plain_repair([(r, x) for _, r, x in held])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        lines = "\n".join(f"{r}:{x}" for r, x in turns)
        found[(conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs),
               cost, audit, hashlib.sha256(lines.encode()).hexdigest())] += 1
    return found


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text, fault == 0)] * (2 if fault == 3 else 1)
    return out


def conversations():
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "more words. \n", "dots...", "ünï.", None, "end.  "]
    roles = ["system", "user", "assistant", "tool", "", None, "User", "sa", "u", "a"]
    rows = []
    for conv in range(150):
        for turn in range(R.randrange(0, 9)):
            role = R.choice(roles) if R.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn if R.random() < 0.95 else None, role, R.choice(texts) if R.random() < 0.4 else f"Text {R.random()}."))
    rows += [(None, t, "user", "Lost.") for t in (1, 2, None)] + rows[:3]
    rows += [(900, None, r, "x.") for r in ("user", "assistant")] + [(901, 2**40, "user", "a."), (901, -5, "assistant", "b.")]
    rows += [(902, t, R.choice(roles[:4]), R.choice(texts) if t % 5 else f"n {t}.") for t in range(700)]  # over many segments
    rows += [(903, 1, "user", "same.")] * 300
    return rows


def tie_order(spark, pairs):
    frame = spark.createDataFrame(sorted(pairs), "role string, text string").select("role", "text", F.xxhash64("role", "text").alias("h"))
    return {(r.role, r.text): r.h for r in frame.collect()}


def result(df):
    return collections.Counter(tuple(r) for r in df.select("conv_id", *c.RESULTS).collect())


@pytest.mark.parametrize("segment", [c.SEGMENT, 7])
def test_repair_equals_plain_search(spark, segment):
    rows = conversations()
    hurt = plain_damage(rows)
    expected = plain(hurt, tie_order(spark, {(r, x) for _, _, r, x, _ in hurt}))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations then lie over several partitions
    try:
        assert result(c.repair(c.damaged(frame(spark, rows)), gone=F.col("gone"), segment=segment)) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_turns_are_those_of_the_digest(spark):
    rows = [r for r in conversations() if r[0] is not None]
    turns = collections.defaultdict(list)
    for r in c.repaired_turns(frame(spark, rows), segment=7).collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    for r in c.repair(frame(spark, rows), segment=7).collect():
        found = sorted(turns[r.conv_id])
        assert [t for t, *_ in found] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for _, x, _ in found))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{x}:{t}" for _, x, t in found).encode()).hexdigest()


def test_op12_over_the_conversations(spark):
    root = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{root}/conversations.parquet")
    rows = plain_damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert result(c.op12(spark, root)) == plain(rows)


def test_lightest_of_all_edit_strings():
    """Every string of edits over up to four rows, tried one by one."""

    def price(signs, audit):
        cost, state, i = 0, "", 0
        for letter in audit:
            role = "a" if state == "u" else "u"
            if letter == "I":
                cost, state = cost + 5, role
                continue
            if i == len(signs):
                return None
            sign, i = signs[i], i + 1
            if letter == "D":
                cost += 2
                continue
            state = next_state(state, sign.lower() if letter == "K" else role)
            if sign == "d" or state is None:
                return None
            cost += (letter == "R") + 5 * sign.isupper()
        return cost if i == len(signs) and state in ("", "a") else None

    for n in range(5):
        strings = ["".join(s) for k in range(n, n + 2) for s in itertools.product("DIKR", repeat=k) if s.count("I") == k - n]
        for signs in itertools.product("dsuaxUA", repeat=n) if n < 4 else [R.choices("dsuaxSUAX", k=4) for _ in range(60)]:
            signs = "".join(signs)
            assert c.cheapest(signs) == min((p, s) for s in strings if (p := price(signs, s)) is not None)


def test_empty_table(spark):
    assert c.repair(frame(spark, [])).collect() == [] and c.repaired_turns(frame(spark, [])).collect() == []
    only = c.repair(frame(spark, [(1, 0, "user", "a")]), gone=F.lit(True)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
