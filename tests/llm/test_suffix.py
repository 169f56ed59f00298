"""Repeated byte strings in many surroundings against counting every string."""

import collections
import hashlib
import random
import re

import pytest
from test_operators import frame

from remitlake.llm import suffix_dedup

R = random.Random(8)


def plain(rows, width=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[k : k + width] for _, t in data for k in range(len(t) - width + 1))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return collections.Counter(out)


def noise(n):
    return "".join(R.choice("abcdefgh ") for _ in range(n))


@pytest.mark.parametrize("group", [1, 20, suffix_dedup.GROUP])
def test_passages_in_many_surroundings(spark, monkeypatch, group):
    """Passages below, at and above the width, in surroundings that differ at once, late, on one side or not at all."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    passages = [noise(n) for n in (40, 150, 399, 400, 401, 450, 800)]
    tails = [noise(120) for _ in range(3)]
    rows = []
    for i in range(150):
        text = noise(R.randrange(0, 300)) + R.choice(["", R.choice(tails)]) + R.choice(passages) + R.choice([R.choice(tails), ""]) + noise(R.randrange(0, 300))
        rows.append((i, text + R.choice(["", R.choice(passages)])))
    rows += [(200, rows[0][1]), (201, "ab" * 500), (None, rows[1][1]), rows[2], (202, None)]
    found = suffix_dedup.suffix_dedup(frame(spark, rows).repartition(5), outline=True, batches=2)
    assert collections.Counter(map(tuple, found.collect())) == plain(rows)


def test_common_length():
    for _ in range(3000):
        one, two = (bytes(R.choice(b"ab") for _ in range(R.randrange(12))) for _ in range(2))
        expected = next((k for k, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
        assert suffix_dedup._common(one, two) == expected


def test_a_short_passage_makes_no_windows(spark):
    """A passage that is too short to be a string of the width leaves no window to look at, however often it stands."""
    passage = noise(100)
    rows = [(i, noise(700) + passage + noise(700)) for i in range(60)]
    data = [(i, t, suffix_dedup.owners(suffix_dedup.as_bytes(t), 400)[0].tolist()) for i, t in rows]
    docs = spark.createDataFrame(data, "key long, text string, places array<int>")
    around = docs.mapInArrow(suffix_dedup._surroundings(400), "p long, digest binary, span binary, key long, lo int, place int")
    classes = around.selectExpr("p", "digest", "span", "place", "1L size")
    found = suffix_dedup._repeated_in_large(classes.coalesce(1), 400)
    assert found.collect() == []
