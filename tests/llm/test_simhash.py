"""SimHash groups against all pairs, the chains against plain Hamming distances."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from remitlake.llm import simhash

from test_operators import ROWS, frame, words

R = random.Random(13)


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lower)
    pieces = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(p.encode("utf-8"), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Smallest id reachable of each row, by comparing every pair of rows."""
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return collections.Counter((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group))


def near_rows():
    """Long texts with a few words changed, so that fingerprints differ in 0 to 6 bits, and chains of such texts."""
    out = []
    for k in range(12):
        base = words(400).split()
        for step in range(12):
            out.append((1000 + 100 * k + step, " ".join(base)))
            for _ in range(R.randrange(1, 4)):
                base[R.randrange(len(base))] = "other"
    return out


@pytest.mark.parametrize("block", [simhash.BLOCK, 2])
def test_groups_equal_all_pairs(spark, block):
    rows = ROWS + near_rows()
    found = simhash.simhash_groups(frame(spark, rows), columns=("label", "row"), block=block)
    assert found.columns == ["doc_id", "label", "row", "fingerprint", "component_id"]
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in found.collect())
    assert got == plain_groups(rows)
    assert any(i != c for i, _, c in got if i is not None and i >= 1000)


def test_empty_table_and_clashing_names(spark):
    assert simhash.simhash_groups(frame(spark, [])).collect() == []
    with pytest.raises(ValueError, match="fingerprint"):
        simhash.simhash_groups(frame(spark, []).withColumnRenamed("label", "fingerprint"), columns=("fingerprint",))


def test_every_near_pair_passes_a_chain():
    for _ in range(2000):
        one = R.getrandbits(64)
        other = one
        for bit in R.sample(range(64), R.randrange(0, 7)):
            other ^= 1 << bit
        near = bin(one ^ other).count("1") <= 3
        pair = np.array([one, other], dtype=np.uint64)
        met = [s for s in range(4) if len(simhash.chain_hits(simhash._turn(pair, s)[0], simhash._turn(pair, s)[1:]))]
        assert bool(met) == near


def test_one_key_with_very_many_fingerprints(spark):
    """A ball of fingerprints that share keys: linked as one component whether compared at once or in blocks."""
    centre = R.getrandbits(64) >> 1
    ball = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)})
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in ball], "fp long")
    links = [tuple(r) for r in simhash.fingerprint_links(distinct, block=64).collect()]
    group = {x: x for x in ball}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in links:
        u, v = u % (1 << 64), v % (1 << 64)
        assert bin(u ^ v).count("1") <= 3
        group[top(u)] = top(v)
    assert len({top(x) for x in ball}) == 1


def test_op13_over_the_documents(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op13(spark, root).collect())
    assert got == plain_groups(rows)
