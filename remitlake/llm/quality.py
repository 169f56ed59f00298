"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

DataFrame functions only. Each text is looked at within its own row; nothing is shuffled but counts of vote patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, whole_text

WINDOW, ROUNDS = 8, 60
GOOD, ABSTAIN, BAD = 2, 1, 0
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "on", "are", "this", "was", "be", "by",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "der", "die", "und", "den",
    "das", "von", "zu", "mit", "ist", "el", "los", "las", "y", "una", "por", "con", "se", "del",
)
WHITE = "[ \\x09-\\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _same_neighbour(pairs: Column, p: Column, j: Column) -> Column:
    other = lambda k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
    return other(j - 1) | other(j + 1)


def _covered(hashes: Column) -> Column:
    """How many words the windows cover whose hash occurs twice or more: equal hashes meet when sorted."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = _let(pairs, lambda ps: F.filter(ps, lambda p, j: _same_neighbour(ps, p, j)))
    ordered = F.sort_array(F.transform(starts, lambda p: p["i"]))
    gaps = _let(
        ordered,
        lambda s: F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW)))),
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_m``, a struct of counts over the whole text (null: no words)."""
    text = whole_text(text_col)
    words = F.array_remove(F.split(text, WHITE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^ \\x09-\\x0D]")))
    docs = docs.withColumn("_words", words).withColumn("_lines", lines)
    w = F.col("_words")
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    docs = docs.withColumn(
        "_hashes", F.when(F.size(w) >= WINDOW, F.slice(hashes, F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))
    )
    h = F.col("_hashes")
    repeats = F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long"))
    stops = F.array(*[F.lit(x) for x in STOP_WORDS])
    head = F.transform(w, lambda x: F.lower(x))
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
        F.size(F.array_intersect(head, stops)).cast("long").alias("n_stop_words"),
    )
    return docs.withColumn("_m", measures).drop("_words", "_lines", "_hashes")


def votes() -> list[Column]:
    """The rules' votes over ``_m``: BAD, ABSTAIN or GOOD. Ratios compare integers, so every engine agrees."""
    m = lambda name: F.col("_m")[name]
    n, chars = m("n_words"), m("word_chars")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return [
        vote(20 * m("n_symbols") > 3 * n, 50 * m("n_symbols") <= n),
        vote(20 * m("n_upper") > 3 * chars, 20 * m("n_upper") <= chars),
        vote(20 * m("n_shouts") > n, 200 * m("n_shouts") <= n),
        vote(10 * m("n_repeat_words") > 3 * n, m("n_repeat_words") == 0),
        vote(10 * m("n_dup_lines") > 3 * m("n_lines"), (m("n_dup_lines") == 0) & (m("n_lines") > 1)),
        vote((2 * n > chars) | (chars > 15 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        vote((n >= 50) & (m("n_stop_words") <= 1), m("n_stop_words") >= 4),
    ]


def pattern_code() -> Column:
    """All votes as one number in base 3."""
    code = F.lit(0)
    for v in votes():
        code = code * 3 + v
    return code


def estimate(counts: dict[int, int], n_rules: int, rounds: int = ROUNDS) -> dict[int, float]:
    """Posterior probability of good quality of each vote pattern.

    A rule's votes are independent given the quality, with unknown rates of good, bad and abstaining votes for good and for
    bad texts: its accuracies. Expectation-maximisation starts from "no rule objects" and runs ``rounds`` times over at
    most 3^rules patterns. Rates are smoothed by one vote each.
    """
    patterns = {c: [c // 3 ** (n_rules - 1 - j) % 3 for j in range(n_rules)] for c in sorted(counts)}
    good = {c: 0.1 if BAD in p else 0.9 for c, p in patterns.items()}
    for _ in range(rounds):
        weight = [1.0, 1.0]
        rates = [[[1.0, 1.0, 1.0] for _ in range(n_rules)] for _ in range(2)]
        for c, p in patterns.items():
            for y, share in ((1, good[c]), (0, 1 - good[c])):
                weight[y] += counts[c] * share
                for j, v in enumerate(p):
                    rates[y][j][v] += counts[c] * share
        for c, p in patterns.items():
            score = [weight[0], weight[1]]
            for y in (0, 1):
                for j, v in enumerate(p):
                    score[y] *= rates[y][j][v] / (weight[y] + 2)
            good[c] = score[1] / (score[0] + score[1])
    return good


def accepted(measured: DataFrame, threshold: float = 0.5) -> list[int]:
    """The vote patterns of good quality, from the counts of all patterns in ``measured`` (with ``_m``): at most 3^rules."""
    found = measured.groupBy(pattern_code().alias("code")).agg(F.count(F.lit(1)).alias("n")).collect()
    posterior = estimate({r["code"]: r["n"] for r in found}, len(votes()))
    return sorted(c for c, p in posterior.items() if p >= threshold)


def base_failed() -> Column:
    m = F.col("_m")
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def kept(good: list[int]) -> Column:
    return ~base_failed() & (pattern_code().isin(good) if good else F.lit(False))


def quality_rules(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row, beside ``columns``.

    Texts with fewer than 20 words, or more than 30 per cent of them in repeated 8-word windows, fail; of the others those
    are kept whose posterior probability of good quality is at least one half. Null, empty and blank texts have no words,
    get abstentions and fail. One row per input row, whatever the ids; equal rows are judged alike. No rows in, none
    out. Windows are compared by 64-bit hashes within one text.
    """
    rows = docs.select(*columns, F.col(text_col).alias("_text"))
    measured = stored(with_measures(rows, "_text").select(*columns, "_m"), "measures")
    return measured.select(
        *columns, *[F.col("_m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"), kept(accepted(measured)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns. The counts are stored beside the rows: a
    filter on computed columns would be moved below them and compute them anew for each use."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(text_col).alias("_text"))
    measured = stored(with_measures(rows, "_text").select("_row", "_m"), "measures")
    return measured.where(kept(accepted(measured))).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
