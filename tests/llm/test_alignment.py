"""Aligned tokens against the two libraries and a walk over byte offsets."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_operators import ROWS, frame
from tokenizers import Tokenizer

from remitlake.llm import alignment

R = random.Random(11)
ODD = [
    " leading", "trailing ", "two  spaces", "\n\nbreaks \n here\n", "a\tb\r\nc", "<s>x</s> <unk> <0x41>", "<|endoftext|>",
    "mark ▁ inside", "▁", "\0null\0", "é é ﬁ ½", "日本語のテキスト", "😀👍🏽", " nbsp​", " ", "\n", "x" * 400, "a b c d",
    "don't we'll 12345 ... !!!", "".join(R.choice("ab \n.▂é") for _ in range(500)),
]
CASES = ROWS + [(2000 + i, t) for i, t in enumerate(ODD)]


def library_tokens():
    """For a text the ids and bytes of both libraries' tokens, as the libraries give them for the whole text."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}

    def of(text):
        if not text:
            return [], []
        one = a.encode(" " + text, add_special_tokens=False).ids
        two = b.encode(text)
        one = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in one]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in two]
        whole = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])

    return of


def plain(rows):
    """Expected rows from sets of byte offsets."""
    of, found, counts = library_tokens(), [], collections.Counter()
    for i, text in rows:
        one, two = of(text)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (one, two)]
        both = set(ends[0]) & set(ends[1])
        cuts = sorted(both)
        places = [[k for k, e in enumerate(es) if e in both] for es in ends]
        links = [(one[x][0], two[y][0]) for x, y in zip(*places)]
        parts, lo = [], (0, 0)
        for hi in zip(*places):
            parts.append("|".join(",".join(str(t) for t, _ in side[p : q + 1]) for side, p, q in zip((one, two), lo, hi)))
            lo = tuple(q + 1 for q in hi)
        counts.update(links)
        found.append((i, len(one), len(two), len(cuts), links, ";".join(parts)))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return collections.Counter(
        (i, na, nb, n, len(links), hashlib.sha256(g.encode()).hexdigest() if g else "",
         sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
        for i, na, nb, n, links, g in found
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_scored_equals_the_libraries(spark):
    found = alignment.scored(frame(spark, CASES))
    assert found.columns == COLUMNS
    assert collections.Counter(map(tuple, found.collect())) == plain(CASES)


def test_op11_over_the_documents(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, alignment.op11(spark, root).collect())) == plain(rows)


def test_links_and_ids_rebuild_the_text(spark):
    of = library_tokens()
    texts = {i: t for i, t in CASES if i is not None}
    rows = alignment.align(frame(spark, [(i, t) for i, t in texts.items()]), columns=("label",)).collect()
    assert len(rows) == len(texts) and rows[0].label == "l"
    for r in rows:
        one, two = of(texts[r.doc_id])
        assert r.a_ids == [i for i, _ in one] and r.b_ids == [i for i, _ in two] and len(r.link_a) == r.n_links
        ends = [np.cumsum([len(t) for _, t in side]).astype(int) for side in (one, two)]
        assert (ends[0][r.link_a] == ends[1][r.link_b]).all()
        assert sum(r.times) == r.n_links and len(r.pairs) == len(set(r.pairs))


def test_words_of_pieces_equal_whole_texts():
    side = alignment.tokens(alignment.B_NAME)
    for _ in range(300):
        text = "".join(R.choice(["a", "the", " ", "\n", ".", "ß", "日", "\t", "ing", "0"]) for _ in range(R.randrange(1, 40)))
        assert side.encode([text])[0].tolist() == side.library.encode(text)


def test_possible_pairs_bound_the_links():
    a, b = ([alignment.tokens(n).bytes for n in (alignment.A_NAME, alignment.B_NAME)])
    assert alignment.possible_pairs([b"ab", b"b", b""], [b"b", b"ab", b"b", b"cab"]) == 4 + 4
    assert 48 * alignment.possible_pairs(a, b) <= 32 << 20


def test_lockstep_of_random_cuts():
    for _ in range(200):
        a, b, a_first, b_first, expected = [], [], [0], [0], []
        for _ in range(R.randrange(0, 6)):
            n = R.randrange(0, 12)
            one, two = (sorted({n, *(R.randrange(1, n) for _ in range(R.randrange(0, n)) if n > 1)}) if n else [] for _ in "ab")
            expected += [len(b) + two.index(e) if e in two else -1 for e in one]
            a, b = a + one, b + two
            a_first.append(len(a))
            b_first.append(len(b))
        found = alignment.lockstep(*(np.array(x, dtype=np.int64) for x in (a, a_first, b, b_first)))
        assert found.tolist() == expected


def test_empty_table_and_clashing_names(spark):
    assert alignment.scored(frame(spark, [])).collect() == []
    with pytest.raises(ValueError, match="n_a"):
        alignment.align(frame(spark, []).withColumnRenamed("label", "n_a"), columns=("n_a",))
    with pytest.raises(ValueError, match="_row"):
        alignment.scored(frame(spark, []).withColumnRenamed("label", "_row"), columns=("_row",))
