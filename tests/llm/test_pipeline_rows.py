"""The pipeline's stages, row by row, against plain versions that know nothing of Spark: each on what the stage before kept."""

import collections
import math

import numpy as np
import pytest
import regex
from test_operators import ROWS, base_spans, frame, groups, split

import corpus_pipeline
from remitlake.llm import pii, quality
from remitlake.llm.tokenizer_cache import cached

STOPS = set(quality.STOP_WORDS)


def votes(text):
    """Two for good, nought for bad, one for no opinion."""
    w = [x.decode() for x in split(text)]
    n, chars = len(w), sum(map(len, w))
    if not n:
        return (1,) * 7, True
    grams = collections.Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    repeated = len({k + j for k in range(n - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)})
    lines = [x for x in text.split("\n") if x.encode().split()]
    dup = len(lines) - len(set(lines))
    symbols, upper = len(regex.findall(r"[#*$%&|<>]", text)), len(regex.findall("[A-Z]", text))
    shouts, stops = len(regex.findall("[!?]{2,}", text)), len({x.lower() for x in w} & STOPS)

    def vote(bad, good):
        return 0 if bad else 2 if good else 1

    found = (
        vote(symbols / n > 0.15, symbols / n <= 0.02), vote(upper / chars > 0.15, upper / chars <= 0.05),
        vote(shouts / n > 0.05, shouts / n <= 0.005), vote(repeated / n > 0.3, not repeated),
        vote(dup / len(lines) > 0.3, not dup and len(lines) > 1), vote(chars / n < 2 or chars / n > 15, 3 <= chars / n <= 10),
        vote(n >= 50 and stops <= 1, stops >= 4),
    )
    return found, n < 20 or 100 * repeated > 30 * n


def plain_kept(texts):
    """Expectation-maximisation over the rows themselves."""
    seen = [votes(t or "") for t in texts]
    table = np.array([v for v, _ in seen])
    good = np.where((table == 0).any(axis=1), 0.1, 0.9)
    for _ in range(quality.ROUNDS):
        score = []
        for share in (1 - good, good):
            weight = 1 + share.sum()
            rates = np.array([[1 + share[table[:, j] == v].sum() for v in range(3)] for j in range(7)]) / (weight + 2)
            score.append(weight * np.prod([rates[j][table[:, j]] for j in range(7)], axis=0))
        good = score[1] / (score[0] + score[1])
    return [bool(g >= 0.5) and not failed for g, (_, failed) in zip(good, seen)]


def plain_groups(rows):
    members = collections.defaultdict(list)
    for (i, t), (n, _, group, _) in zip(rows, groups([(n, t) for n, (_, t) in enumerate(rows)])):
        members[group].append((i is None, i, n, t))
    return [min(m)[1::2] for m in members.values()]


def plain_cut(rows, width=35):
    counts = collections.Counter(tuple(w[k : k + width]) for _, t in rows for w in [split(t)] for k in range(len(w) - width + 1))
    out = []
    for i, t in rows:
        w = split(t)
        gone = {k + j for k in range(len(w) - width + 1) if counts[tuple(w[k : k + width])] > 1 for j in range(width)}
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t))
    return out


def plain_terms(rows):
    """Per row the places of revealing terms with their share, from plain counts."""
    n = max(len(rows), 2)
    with_e, with_t, both, bases, words = collections.Counter(), collections.Counter(), collections.Counter(), [], []
    for _, t in rows:
        t = t or ""
        base = list(base_spans(t))
        entities = set()
        for kind, a, b in base:
            value = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else regex.sub("[^0-9]", "", t[a:b])
            wide = value[value.index("@") :] if kind == "email" else value[: value.rindex(".") + 1] if kind == "ip" else value[: 6 if kind == "card" else 4]
            entities |= {f"{kind}:{value}", f"{kind} of {wide}"}
        places = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t)]
        free = [(a, b, w) for a, b, w in places if not any(x < b and y > a for _, x, y in base)]
        with_e.update(entities)
        with_t.update({w for *_, w in places})
        both.update((e, w) for e in entities for w in {w for *_, w in free})
        bases.append(base)
        words.append(free)

    def told(te, t, e):
        beside = (te + pii.PRIOR * e / n) / (t + pii.PRIOR)
        return math.log2(beside * n / e) / math.log2(n / e) if beside > 0 else -9.0

    shares, sure = {}, set()
    for (e, w), te in both.items():
        if with_e[e] < n and told(te, with_t[w], with_e[e]) >= pii.DISCLOSURE:
            shares[w] = max(shares.get(w, 0), told(te, with_t[w], with_e[e]))
            if told(te - 1, with_t[w] - 1, with_e[e]) >= pii.DISCLOSURE:
                sure.add(w)
    return bases, [
        [(a, b, shares[w]) for a, b, w in free if w in shares and (w in sure or any(x - b <= pii.NEAR and a - y <= pii.NEAR for _, x, y in base))]
        for base, free in zip(bases, words)
    ]


def plain_sanitised(rows):
    out = []
    for (i, t), base, terms in zip(rows, *plain_terms(rows)):
        cuts = sorted([(a, b, f"[{k.upper()}]") for k, a, b in base] + [(a, b, "" if s >= pii.REMOVE else "[TERM]") for a, b, s in terms])
        at, text = 0, ""
        for a, b, tag in cuts:
            if a >= at:
                text += t[at:a] + tag
            at = max(at, b)
        out.append((i, t if t is None else text + t[at:]))
    return out


@pytest.mark.parametrize("source", ["small corpus", "documents"])
def test_every_stage_row_by_row(spark, source):
    if source == "documents":
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 20000")
    else:
        docs = frame(spark, ROWS)
    plain = {
        "quality_rules": lambda rows: [r for r, k in zip(rows, plain_kept([t for _, t in rows])) if k],
        "minhash_near_duplicates": plain_groups, "substring_dedup": plain_cut, "personal_data": plain_sanitised,
    }
    now = corpus_pipeline.stored(docs, "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in now.select("doc_id", "text").collect()]
        after = corpus_pipeline.stored(stage(spark, now, ""), name)
        found = [tuple(r) for r in after.select("doc_id", "text").collect()]
        assert collections.Counter(found) == collections.Counter(plain[name](rows)), name
        if "n_chars" in after.columns:
            assert after.where("n_chars <> length(text)").count() == 0
        now = after
    rows = {i: t for i, t in now.select("doc_id", "text").collect()}
    pieces = [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, now, "").select("doc_id", "piece", "start", "length", "sequence_id", "offset").collect()]
    tokens = collections.Counter()
    for i, _, _, length, _, _ in pieces:
        tokens[i] += length
    library = cached("byte_bpe_50k.json")._library([t or "" for t in rows.values()])
    assert tokens == collections.Counter({i: len(x) // 4 + 1 for i, x in zip(rows, library)})
    filled = collections.defaultdict(list)
    for _, _, _, length, sequence, offset in pieces:
        filled[sequence].append((offset, length))
    for places in filled.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
