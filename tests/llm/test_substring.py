"""Repeated word windows against counting every window."""

import collections
import hashlib
import random

import numpy as np
import pytest
from test_operators import frame, words

from remitlake.llm import substring_dedup as sub

R = random.Random(10)


def plain(rows, width=35):
    counts, split = collections.Counter(), [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        counts.update(tuple(w[j : j + width]) for j in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if counts[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def cut_rows():
    """Passages of lengths around the window's, in many surroundings, at the ends of texts, in copies and near copies."""
    passages = [words(n) for n in (34, 35, 36, 40, 47, 48, 60, 90)]
    rows = []
    for i in range(120):
        parts = [words(R.randrange(0, 40)), R.choice(passages), words(R.randrange(0, 15)), R.choice(passages)[:], words(R.randrange(0, 5))]
        rows.append((i, " ".join(parts[: R.randrange(2, 6)])))
    base = words(200).split()
    for i in range(40):
        near = list(base)
        for _ in range(R.randrange(0, 4)):
            near[R.randrange(200)] = R.choice(["other", "words"])
        rows.append((1000 + i, " ".join(near)))
    rows += [(2000, "ab " * 36), (2001, "ab " * 35), (2002, "ab cd " * 100), (3000, rows[0][1]), (None, rows[1][1]), rows[2]]
    return rows


def test_windows_in_many_surroundings(spark):
    rows = cut_rows()
    found = sub.substring_dedup(frame(spark, rows).repartition(6), outline=True)
    assert collections.Counter(map(tuple, found.collect())) == plain(rows)


def test_op10_over_the_documents(spark):
    root = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    found = sub.op10(spark, root).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert collections.Counter(map(tuple, found.collect())) == plain(rows)


def test_settling_does_not_depend_on_batches():
    """Entries of few hashes, cut into batches anywhere."""
    import pyarrow as pa

    for _ in range(200):
        n = R.randrange(1, 40)
        h, c = (np.array([R.randrange(3) for _ in range(n)], dtype=np.uint64) for _ in range(2))
        keys = np.arange(n, dtype=np.int64)
        batch = sub._collapsed(h, c, keys, keys * 0 + 5) if R.random() < 0.5 else pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (h.view(np.int64), c.view(np.int64), keys, keys * 0 + 20)], names=["h", "c", "key", "code"]
        )
        batch = batch.sort_by([("h", "ascending"), ("c", "ascending")])
        cuts = sorted({0, n, *(R.randrange(n) for _ in range(R.randrange(4)))})
        parts = [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        found = [tuple(r.values()) for part in sub._settle(iter(parts)) for r in part.to_pylist()]
        sure = {k for k, at, s in found if s}
        count = collections.Counter(zip(h.tolist(), c.tolist()))
        assert sure == {k for k in range(n) if count[h[k], c[k]] > 1} and {at for _, at, _ in found} <= {5}
        classes = collections.Counter(x for x, _ in count)
        edges = collections.Counter((int(h[k]), int(c[k])) for k, _, s in found if not s)
        assert edges == {x: 1 for x in count if classes[x[0]] > 1}


def test_surroundings_tell_the_ends_apart():
    values = np.array([R.getrandbits(64) for _ in range(60)], dtype=np.uint64)
    anchors = np.arange(0, 60 - 22)
    found = sub._surroundings(values, anchors, 35)
    assert len(set(found.tolist())) == len(anchors)
    again = sub._surroundings(np.r_[values[5:], values[:5]], np.array([20]), 35)
    assert again[0] == found[25]


@pytest.mark.parametrize("period, cover", [(sub.PERIOD, sub.COVER)])
def test_cover(period, cover):
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
