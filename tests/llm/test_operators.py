"""Every operator against a brute-force version on a small corpus with awkward rows, on an empty table and with extra columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from remitlake.llm import byte_bpe, minhash, mtree, packing, pii, quality, substring_dedup, suffix_dedup, token_store, url_filter
from remitlake.llm.components import components
from remitlake.llm.tokenizer_cache import cached

os.environ["TOKENIZERS_PARALLELISM"] = "false"
R = random.Random(4)
VOCABULARY = [f"{a}{b}" for a in ("re", "ti", "on", "the", "né", "Wh", "es") for b in ("ka", "lo", "mu", "x.", "y,", "ß")]
VOCABULARY += ["the", "of", "and", "to", "in", "a", "de", "la"]


def words(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Copies, near copies, a shared passage, repeats within a text, blank, null, short and long texts, repeated rows."""
    base, passage, long = words(120), words(60), words(6000)
    near = base.split(" ")
    near[50] = "changed"
    texts = [
        base, base, " ".join(near), words(40) + " " + passage + "\n" + words(30), passage + " " + words(50),
        words(30) + " " + passage, None, "", " \n\t ", "one", "two words", base.upper(), long, long[: len(long) // 2],
        "ab " * 300, words(35), "mail jo.x@mail.example.com or +1 (017) 555-7713, 10.0.0.1 and 4111 1111 1111 1111 " + words(30),
        "<|endoftext|> don't  stop\n\n'll " + words(20), "日本語 텍스트 😀 " + words(25), "x" * 3000, "1" * 2500,
        *(words(R.randrange(1, 90)) for _ in range(20)),
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base), (None, None), (500, passage)]


ROWS = corpus()
EXTRA = "label string, key string, row int, base int, kept boolean, n_words int, `a b` string, _m int"


def frame(spark, rows):
    data = [(i, t, "l", "k", 1, 2, True, 3, "s", 4) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def same(df, expected):
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(expected)


def split(text):
    return (text or "").encode().split()


def test_mtree_finds_the_exact_best(spark):
    rows = [(i, [R.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(3)] if i % 3 else [R.gauss(0, 1) for _ in range(3)]) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(300)]  # ties, over more than one block
    rows += [(2000, None), (2001, [1.0, None, 2.0]), (2002, [float("nan")] * 3), (2003, [float("inf"), 0.0, 0.0]), (None, [1.0] * 3)]
    block, mtree.BLOCK = mtree.BLOCK, 128
    try:
        vectors = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, score int")
        found = mtree.top_k(vectors, "vec_id % 100 = 0")
        good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
        expected = []
        for q in (i for i in good if i % 100 == 0):
            best = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q)[:10]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        same(found, expected)
        assert mtree.top_k(vectors.limit(0), "vec_id % 100 = 0").collect() == []
    finally:
        mtree.BLOCK = block


def test_mtree_prunes():
    points = np.random.RandomState(0).normal(size=(20, 1, 2)) * 1000 + np.random.RandomState(1).normal(size=(20, 100, 2))
    points = points.reshape(-1, 2).round()
    lift = np.sqrt((points**2).sum(axis=1).max() - (points**2).sum(axis=1))
    tree = mtree.Tree(np.arange(2000), np.c_[points, lift])
    looked = []
    tree.nodes = [tuple(n) for n in tree.nodes]

    class Nodes(list):
        def __getitem__(self, i):
            looked.append(i)
            return super().__getitem__(i)

    tree.nodes = Nodes(tree.nodes)
    best = tree.search(np.r_[points[5], 0.0], 5, 10, -np.inf)
    assert sorted(-s for s, _ in best) == sorted(-int(s) for s in np.sort(np.delete(points @ points[5], 5))[::-1][:10])
    assert len(looked) < len(tree.nodes) / 2


def test_bpe_matches_the_library_and_decodes(docs, empty):
    import tiktoken

    e = byte_bpe.encoder(public_tokenizers.path(byte_bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    same(
        byte_bpe.bpe_digests(docs),
        [
            (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in ROWS for ids in [library.encode_ordinary(t or "")]
        ],
    )
    encoded = byte_bpe.bpe_encode(docs)
    for r in encoded.collect():
        assert r["offsets"] == list(np.cumsum([0, *(len(e.pieces[x]) for x in r["ids"])])[:-1])
    same(byte_bpe.bpe_decode(encoded), [(i, (t or "").encode()) for i, t in ROWS])
    assert byte_bpe.bpe_digests(empty).collect() == []
    parts = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\xa0", "a", "é", "1", "²", "!", "漢", "😀", "́", "​", "\r\n"]
    fuzz = ["".join(R.choice(parts) for _ in range(R.randrange(25))) for _ in range(3000)] + ["'" * 300, "ab" * 400]
    assert list(e.encode(fuzz)) == [library.encode_ordinary(t) for t in fuzz]
    points = [chr(c) + "a" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert [len(x) for x in e.encode(points)] == [len(library.encode_ordinary(t)) for t in points]


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            yield kind, m.start(), m.end()


def test_pii_patterns(spark, docs, empty):
    parts = ["a", "@", ".", "-", "+", "1", "23", "4.", "255", " ", "(", "é", "😀", "4111111111111111", "b.c", "a@b.co", "1.2.3.4"]
    fuzz = [(i, "".join(R.choice(parts) for _ in range(R.randrange(30)))) for i in range(1500)]
    fuzz += [(9000, "1" * 20000), (9001, "a@" + "b." * 9000 + "c"), (9002, "1 " * 9000), (9003, "a" * 30000)]
    for df, rows in ((docs, ROWS), (frame(spark, fuzz), fuzz)):
        expected = []
        for i, t in rows:
            spans = list(base_spans(t))
            listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            expected.append((i, *(sum(k == x for k, _, _ in spans) for x in KINDS), hashlib.sha256(listed.encode()).hexdigest(), listed))
        same(pii.pii_digest(df), expected)
    assert pii.pii_digest(empty).collect() == []
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[16].startswith("mail [EMAIL] or [PHONE], [IP] and [CARD] ")
    assert text[6] is None and text[12] == ROWS[12][1]


def test_pii_terms_that_reveal_an_entity(spark):
    """A name that stands with one address in four different texts, and nearly nowhere else, discloses it."""
    rows = [(i, f"{words(5)} Quillfeather writes from q@mail.example.org about {words(8)} item{'abcd'[i]}") for i in range(4)]
    rows += [(10 + i, words(20)) for i in range(200)]
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_digest(frame(spark, rows)).collect()}
    for i, t in rows[:4]:
        a = t.index("Quillfeather")
        assert f"term:{a}:{a + 12}" in spans[i].split(",")
        assert "item" not in [t[int(x.split(":")[1]) :][:4] for x in spans[i].split(",")]
    assert all(not spans[i] for i, _ in rows[4:])
    assert "Quillfeather" not in pii.sanitised(frame(spark, rows)).where("doc_id = 0").first()["text"]


def test_token_store_round_trip_and_lookup(spark, folder, docs, empty):
    library = cached(token_store.TOKENIZER)
    ids = library._library([t or "" for _, t in ROWS])
    path = f"{folder}/store"
    token_store.write_store(docs, path, shard_tokens=500)
    found = [tuple(r) for r in token_store.read_store(spark, path).collect()]
    assert collections.Counter((i, n, c) for i, _, n, c in found) == collections.Counter(
        (i, len(x) // 4 + 1, zlib.crc32(x + b"\2\0\0\0")) for (i, _), x in zip(ROWS, ids)
    )
    at = 0
    for i, start, n, _ in sorted(found, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [i for i, *_ in sorted(found, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    got = collections.Counter((r["key"], tuple(r["ids"])) for r in token_store.lookup(spark, path, [0, 5, 77777]).collect())
    assert got == collections.Counter(
        (i, (*np.frombuffer(x, "<u4").tolist(), 2)) for (i, _), x in zip(ROWS, ids) if i in (0, 5)
    )
    token_store.write_store(empty, f"{folder}/none")
    assert token_store.read_store(spark, f"{folder}/none").collect() == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 40, 20000)).astype(np.uint64)
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    again = token_store.PerfectHash(index.level_bits, np.frombuffer(index.packed(), dtype=np.uint8))
    assert (again.slots(keys) == index.slots(keys)).all()


def test_quality_counts_and_votes(docs, empty):
    expected = {}
    for i, t in ROWS:
        w = split(t)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        expected[i, t] = (
            len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
            len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w),
        )
    found = quality.quality_rules(docs, ("doc_id", "text")).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert tuple(r)[2:8] == expected[r["doc_id"], r["text"]]
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty).collect() == []
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_estimation_separates_good_from_bad():
    """Two rules see the bad texts, one votes at random: texts with an objection end low, others high."""
    counts = collections.Counter()
    for _ in range(4000):
        bad = R.random() < 0.2
        seen = [0 if bad and R.random() < 0.9 else 2 for _ in range(2)]
        counts[seen[0] * 9 + seen[1] * 3 + R.choice([0, 1, 2])] += 1
    good = quality.estimate(counts, 3)
    assert all(good[v] < 0.5 for v in (0, 1, 2)) and all(good[18 + 6 + v] > 0.5 for v in (0, 1, 2))


def test_url_filter(spark):
    urls = [
        None, "no mark", "http://", "HTTP://A.Example.ORG/es/1", "https://example.org/en/12", "http://x.org", "http://x.org/a?b#c",
        "http://b.com/fr/1?utm_source=feed", "http://b.com/de/1", "http://b.net/1?utm_source=feed", "http://b.net/1?utm_source=feeds",
        "http://ads.b.net/", "http://b.net/banner/big/x.gif", "http://b.net/banner/big/x.gif?y", "http://b.net/login", "http://b.net/loginx",
        "http://b.net/a?page=2&ref=x", "http://notexample.org/es/", "http://b.net#/ads/", "http://b.net/adş/", "http://b.net/1?utm_source=feed",
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    compiled = [url_filter.compile_pattern(p) for p in url_filter.PATTERNS]
    by_host = collections.defaultdict(dict)
    for rule, verdict in url_filter.SITE_RULES:
        by_host[rule.partition("/")[0]]["/" + rule.partition("/")[2]] = verdict
    expected = []
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fits = [(h + p, v) for h, ps in by_host.items() for p, v in ps.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=None)
        hits = [] if rule or u is None else [p.text for p in compiled if re.search(p.regex, u.lower(), re.DOTALL)]
        expected.append((i, host, path, rule and rule[0], rule[1] if rule else "block" if hits else "allow", min(hits, default=None)))
    assert sum(e[5] is not None for e in expected) >= 6
    same(url_filter.filter_urls(pages), expected)
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets, parent = [(i, shingles(t)) for i, t in rows if i is not None], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [(i, len(shingles(t)), i if i is None else root(i), i is None or i == root(i)) for i, t in rows]


def test_near_duplicates(spark, docs, empty):
    same(minhash.near_duplicates(docs), groups(ROWS))
    assert minhash.near_duplicates(empty).collect() == []


def test_near_duplicates_where_the_smallest_of_a_bucket_is_unlike_the_others(spark):
    """A chain: each differs from the next in a few words, so its ends are alike only through what lies between."""
    chain, text = [], words(100).split(" ")
    for i in range(25):
        for _ in range(2):
            text[R.randrange(len(text))] = f"new{i}{R.randrange(99)}"
        chain.append((i * 7 % 25, " ".join(text)))
    same(minhash.near_duplicates(frame(spark, chain)), groups(chain))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(5, 5), (70, 65), (None, 3), (65, 70)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: i // 20 * 20 for i in range(61) if i % 20 and i < 60}, 70: 65}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("group", [2048, 1])
def test_suffix_dedup(docs, empty, group):
    width, kept_group = 60, suffix_dedup.GROUP
    suffix_dedup.GROUP = group
    try:
        texts = [(t or "").encode() for _, t in ROWS]
        seen = collections.Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
        expected = []
        for (i, _), t in zip(ROWS, texts):
            gone = bytearray(len(t))
            for k in range(len(t) - width + 1):
                if seen[t[k : k + width]] > 1:
                    gone[k : k + width] = b"\1" * width
            rest = bytes(c for c, g in zip(t, gone) if not g)
            expected.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
        same(suffix_dedup.suffix_dedup(docs, width=width, batches=3, outline=True), expected)
        assert suffix_dedup.suffix_dedup(empty).collect() == []
    finally:
        suffix_dedup.GROUP = kept_group


def test_difference_cover():
    differences = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert differences == set(range(substring_dedup.PERIOD))


def test_substring_dedup(docs, empty):
    seen = collections.Counter(tuple(w[k : k + 35]) for _, t in ROWS for w in [split(t)] for k in range(len(w) - 34))
    expected = []
    for i, t in ROWS:
        w = split(t)
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    same(substring_dedup.substring_dedup(docs, outline=True), expected)
    assert substring_dedup.substring_dedup(empty).collect() == []


def test_packing(docs, empty):
    ids = [x + b"\0\0\0\0" for x in cached(packing.TOKENIZER)._library([t or "" for _, t in ROWS])]
    expected = []
    for (i, _), x in zip(ROWS, ids):
        n = len(x) // 4
        cuts = [0, *range(n - 2048 * (-(-n // 2048) - 1), n, 2048), n]
        expected += [(i, k, a, b - a, zlib.crc32(x[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    found = packing.pack(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in found) == collections.Counter(expected)
    places = collections.defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in places.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) == -(-sum(e[3] for e in expected) // 2048)
    assert packing.pack(empty).collect() == []


def test_packing_plan_is_close_to_the_least():
    for capacity, most in ((2048, 2048), (2048, 700), (100, 60), (10, 10)):
        counts = collections.Counter(R.randrange(1, most + 1) for _ in range(5000))
        runs, total = packing.plan(counts, capacity)
        placed, bins = collections.Counter(), collections.defaultdict(list)
        for s, low, high, base, offset, per in runs:
            placed[s] += high - low
            for rank in range(high - low):
                bins[base + rank // per].append((offset + rank % per * s, s))
        assert placed == counts and len(bins) == total
        for items in bins.values():
            end = 0
            for offset, s in sorted(items):
                assert offset == end
                end += s
            assert end <= capacity and sum(3 * s > capacity for _, s in items) <= 2
        large = sum(n for s, n in counts.items() if 2 * s > capacity)
        assert total <= 1.02 * max(large, sum(s * n for s, n in counts.items()) / capacity) + 1


def test_pipeline_stages(spark, docs, empty):
    for start in (docs, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            after = corpus_pipeline.stored(stage(spark, now, ""), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns
                assert after.count() <= now.count()
            now = after
        assert (now.count() > 0) == (start is docs)


def test_pipeline_keeps_one_row_of_each_group(spark, docs):
    """Also where rows repeat an id or have none; the text of the row that stays is then repeated nowhere."""
    numbered = groups([(n, t) for n, (_, t) in enumerate(ROWS)])
    members = collections.defaultdict(list)
    for (i, t), (n, _, group, _) in zip(ROWS, numbered):
        members[group].append((i is None, i, n, t))
    expected = [min(m)[1::2] for m in members.values()]
    assert len(expected) < len(ROWS)
    once = corpus_pipeline.stored(corpus_pipeline.near_duplicate(spark, docs, ""), "once")
    same(once.select("doc_id", "text"), expected)
    rows = [(7, words(80)), (None, words(80)), (None, None)]
    once = corpus_pipeline.stored(corpus_pipeline.near_duplicate(spark, frame(spark, [*rows, *rows[:2], rows[1]]), ""), "once")
    same(corpus_pipeline.repeated_passages(spark, once, "").select("doc_id", "text"), rows)


@pytest.mark.parametrize("name", [token_store.TOKENIZER, packing.TOKENIZER])
def test_added_tokens_in_a_text_get_their_own_id(name):
    """As a fresh tokenizer of the library does it, without any setting."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "＜|endoftext|>"]
    parts = [*marks, " ", "\n", "hello", "Don't", "é", "漢", "12", ".", ",", "  "]
    texts = ["hello <|endoftext|> world", *[t or "" for _, t in ROWS]]
    texts += ["".join(R.choice(parts) for _ in range(R.randrange(12))) for _ in range(2000)]
    expected = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(expected[0]) == 4 - (name == token_store.TOKENIZER)
    assert [np.frombuffer(x, "<u4").tolist() for x in cached(name).encode(texts)] == expected


def terms_told(df):
    """Per id the words at the places of the listed terms."""
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    told = {}
    for r in pii.pii_digest(df).collect():
        places = [x.split(":")[1:] for x in r["spans"].split(",") if x.startswith("term:")]
        told[r["doc_id"]] = [text[r["doc_id"]][int(a) : int(b)] for a, b in places]
    return told


def test_pii_terms_of_an_entity_in_a_single_text(spark):
    """Names of any length and with digits beside an address that occurs once; words found everywhere stay."""
    rows = [(0, "the Quillfeather of Xu and b72 to q@mail.example.org in a de la"), (1, "+1 (017) 555-7713 a Ñandú la")]
    rows += [(10 + i, words(6) + " the of and to in a de la") for i in range(5000)]
    told = terms_told(frame(spark, rows))
    assert told.pop(0) == ["Quillfeather", "Xu", "b72"] and told.pop(1) == ["Ñandú"]
    assert not any(told.values())


def test_pii_terms_of_a_class(spark):
    """Each address occurs once in few texts, but a word stands with all addresses of the domain."""
    rows = [(i, f"{words(8)} Harrowgate{' ' * (i + 1)}user{i}@clinic.example.org the") for i in range(6)]
    rows += [(10 + i, words(20) + " the") for i in range(200)]
    told = terms_told(frame(spark, rows))
    assert all(told[i] == ["Harrowgate"] for i in range(6)) and not any(told[i] for i, _ in rows[6:])


def test_pii_terms_go_from_rows_without_the_entity_too(spark):
    rows = [(i, f"{words(8)} Larkspurton writes to n{i % 2}@shire.example.org") for i in range(8)]
    rows += [(8, f"{words(8)} larkspurton, LARKSPURTON"), (9, None)]
    rows += [(10 + i, words(20)) for i in range(400)]
    told = terms_told(frame(spark, rows))
    assert all("Larkspurton" in told[i] for i in range(8)) and told[8] == ["larkspurton", "LARKSPURTON"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, rows)).collect()}
    assert not any("larkspurton" in (t or "").lower() for t in clean.values())
    assert clean[8].startswith(rows[8][1].split(" larks")[0]) and clean[9] is None and clean[10] == rows[10][1]
