"""Personal data: patterns find protected entities, co-occurrence over the corpus finds the terms that reveal them.

DataFrame functions only. Patterns use possessive quantifiers and anchors to the start of a run, which match the same
text as the plain ones without backtracking over long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, stored, whole_text
from .quality import _let

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap conditions that every text with a match fulfils.
GUARDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": "[+][0-9]"}
BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{M}\p{N}]++"
#: A term is a disclosure if it gives away this share of an entity's information content; from REMOVE on it is removed,
#: below it is generalised. PRIOR: with so many further texts, in which the entity is as frequent as anywhere, the
#: entity's frequency beside a term is smoothed, so that the fewer texts hold a term, the less it says.
DISCLOSURE, PRIOR, REMOVE = 0.8, 4, 0.95
#: Every word stands beside something once, so one meeting proves nothing. A term is sure if it is a disclosure by the
#: texts besides the one in which it met the entity; a sure term goes everywhere, others only if at most so many code
#: points lie between them and a value.
NEAR = 60
SPAN = "array<struct<kind:string,a:bigint,b:bigint,v:string>>"
TOLD = "array<struct<a:bigint,b:bigint,share:double,sure:boolean>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.rlike(v, F.lit(rf"^0*{BYTE}(?:\.0*{BYTE}){{3}}$"))
    if kind == "card":
        return F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Leftmost matches of a kind that don't overlap, with their code points. What lies between the matches gives their
    places: ``split`` and ``regexp_extract_all`` see the same matches."""
    pattern = PATTERNS[kind]

    def placed(both: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            a = acc["at"] + F.length(F.get(both["gaps"], acc["i"]))
            b = a + F.length(v)
            one = F.array(F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), v.alias("v")))
            return F.struct(
                b.cast("bigint").alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], one.cast(SPAN)).alias("out")
            )

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(both["found"], start, step, lambda acc: acc["out"])

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")
    )
    none = F.array().cast(SPAN)
    valid = F.filter(_let(both, placed), lambda s: _valid(kind, s["v"]))
    return F.when(F.rlike(text, F.lit(GUARDS[kind])), valid).otherwise(none)


def base_spans(text_col: str = "text") -> Column:
    """All valid matches, by kind as in ``KINDS``, then start."""
    return F.concat(*[_matches(whole_text(text_col), k) for k in KINDS])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _entities(s: Column) -> Column:
    """The value of a span, and the class that its value belongs to: mail domain, network, issuer, number prefix."""
    kind, digits = s["kind"], _digits(s["v"])
    value = F.when(kind == "email", F.lower(s["v"])).when(kind == "ip", s["v"]).otherwise(digits)
    wide = (
        F.when(kind == "email", F.regexp_extract(value, "@.*", 0)).when(kind == "ip", F.regexp_extract(value, r"^.*\.", 0))
        .when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )
    return F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit(" of "), wide))


def _told(n_te: Column, n_t: Column, n_e: Column, n: float, prior: int) -> Column:
    """Share of the entity's bits that the term gives away."""
    beside = (n_te + prior * n_e / n) / (n_t + prior)
    return F.log2(beside * n / n_e) / F.log2(n / n_e)


def disclosures(spans: DataFrame, share: float, prior: int) -> DataFrame:
    """(entity, term, share, sure): terms that reveal an entity or its class, from counts over all rows of ``spans``.

    With n documents, n_t of them with the term, n_e with the entity and n_te with both, the entity's frequency beside
    the term is p = (n_te + prior n_e / n) / (n_t + prior), and the term gives away log2(p n / n_e) of the entity's
    log2(n / n_e) bits. ``sure`` tells whether it does so with n_te - 1 and n_t - 1 as well. Pairs that cannot reach
    ``share`` with the largest n_te possible are left out before they are counted. An entity that stands in every row has
    no bits to give away and is left out. ``spans``: row, ``_text``, ``base``.
    """
    n = float(max(spans.count(), 2))
    found = spans.where(F.size("base") > 0)
    entities = found.select("row", F.explode(F.array_distinct(F.flatten(F.transform("base", _entities)))).alias("entity"))
    n_e = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    counted = stored(entities.join(n_e, "entity").where(F.col("n_e") < n), "entities")
    most = counted.agg(F.max("n_e")).first()[0] or 1
    words = spans.select(F.explode(_terms(F.col("_text"))).alias("term"))
    n_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))  # combined before the shuffle: one row per word
    # The bound grows with n_e, so the most frequent entity's one holds for every pair.
    n_t = n_t.where(_told(F.least("n_t", F.lit(most)), F.col("n_t"), F.lit(most), n, prior) >= share - 1e-9)
    free = _words(found).select("row", F.lower("v").alias("term")).distinct()
    rare = stored(free.join(n_t, "term").select("row", "term", "n_t"), "rare")
    possible = _told(F.least("n_t", "n_e"), F.col("n_t"), F.col("n_e"), n, prior) >= share - 1e-9
    pairs = counted.alias("e").join(rare.alias("t"), (F.col("e.row") == F.col("t.row")) & possible)
    scored = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_te")).select(
        "entity", "term", _told(F.col("n_te"), F.col("n_t"), F.col("n_e"), n, prior).alias("share"),
        (_told(F.col("n_te") - 1, F.col("n_t") - 1, F.col("n_e"), n, prior) >= share).alias("sure"),
    )
    return stored(scored.where(F.col("share") >= share), "disclosures")


def _words(rows: DataFrame) -> DataFrame:
    """(row, a, b, v): the words of ``_text`` outside the base spans, with their places."""
    both = F.arrays_zip(F.split("_text", TERM, -1).alias("gap"), F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)).alias("v"))
    words = rows.select("row", "base", F.posexplode(both).alias("i", "w")).select(
        "row", "base", "i", F.col("w.v").alias("v"), F.length("w.v").alias("n"),
        (F.length("w.gap") + F.coalesce(F.length("w.v"), F.lit(0))).alias("step"),
    )
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("b", F.sum("step").over(so_far)).withColumn("a", F.col("b") - F.col("n"))
    free = ~F.exists("base", lambda s: (s["a"] < F.col("b")) & (s["b"] > F.col("a")))
    return words.where("v IS NOT NULL").where(free).select("row", "a", "b", "v")


def _marks(spans: DataFrame, telling: DataFrame) -> DataFrame:
    """(row, marks): the terms of a row that reveal any entity, with their largest share over the entities, whether or
    not the row holds one of them: a sure term gives the entity away there as well."""
    terms = stored(telling.groupBy("term").agg(F.max("share").alias("share"), F.bool_or("sure").alias("sure")), "terms")
    held = spans.select("row", F.explode(_terms(F.col("_text"))).alias("term"))
    held = held.join(bounded(terms, 64 * terms.count()), "term")
    return stored(held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("share", "sure")))).alias("marks")), "marks")


def _marked(text: Column, marks: Column) -> Column:
    """Places, shares and sureness of the words that ``marks`` holds, in order. One pass within the row, so no word is shuffled."""
    both = F.arrays_zip(F.split(text, TERM, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("v"))
    none = F.array().cast(TOLD)

    def step(acc: Column, w: Column) -> Column:
        a = acc["at"] + F.length(w["gap"])
        b = a + F.coalesce(F.length(w["v"]), F.lit(0))
        mark = F.try_element_at(marks, F.lower(w["v"]))
        one = F.array(F.struct(a.alias("a"), b.alias("b"), mark["share"].alias("share"), mark["sure"].alias("sure"))).cast(TOLD)
        return F.struct(b.alias("at"), F.when(mark.isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def personal_spans(
    docs: DataFrame, columns: tuple[str, ...], text_col: str = "text", share: float = DISCLOSURE, prior: int = PRIOR,
) -> DataFrame:
    """``columns``, ``_text``, ``base`` (spans of the patterns) and ``told`` (spans of revealing terms: a, b, share,
    sure) of every row: the sure ones anywhere, the others near a value.

    Rows are numbered when the patterns' matches are stored, so null and repeated ids need no care. Null and empty texts
    have no span. No rows in, none out.
    """
    spans = docs.select(*columns, whole_text(text_col).alias("_text"), base_spans(text_col).alias("base"))
    spans = stored(spans.withColumn("row", F.monotonically_increasing_id()), "spans")
    marks = _marks(spans, disclosures(spans, share, prior))

    def shown(w: Column) -> Column:
        free = ~F.exists("base", lambda s: (s["a"] < w["b"]) & (s["b"] > w["a"]))
        return free & (w["sure"] | F.exists("base", lambda s: (s["a"] - w["b"] <= NEAR) & (w["a"] - s["b"] <= NEAR)))

    told = F.filter(_marked(F.col("_text"), F.col("marks")), shown)
    told = F.when(F.col("marks").isNotNull(), told).otherwise(F.array().cast(TOLD))
    # About as many rows hold a term as not, so the sides are shuffled at any size.
    return spans.join(marks, "row", "left").withColumn("told", told).drop("row", "marks")


def _listed(spans: Column, kind: Column | None = None) -> Column:
    def one(s: Column) -> Column:
        return F.concat_ws(":", s["kind"] if kind is None else kind, s["a"].cast("string"), s["b"].cast("string"))

    return F.transform(spans, one)


def pii_digest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Counts per kind, ``base_sha256`` and the listed ``spans`` (base ones first, then ``term``) of every row."""
    spans = personal_spans(docs, columns, text_col)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = _listed(F.col("base"))
    return spans.select(
        *columns, *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed(F.col("told"), F.lit("term"))), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets, and revealing terms generalised to ``[TERM]`` or,
    from ``REMOVE`` on, removed. Rows without either keep their text, null included."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(text_col).isNull().alias("_null"), *[F.col(f"`{c}`") for c in others])
    spans = personal_spans(docs.select(row.alias("_row"), text_col), ("_row",), text_col)
    cut = "array<struct<a:bigint,b:bigint,tag:string>>"
    base = F.transform("base", lambda s: F.struct(s["a"], s["b"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("tag")))
    told = F.transform("told", lambda s: F.struct(s["a"], s["b"], F.when(s["share"] >= REMOVE, "").otherwise("[TERM]").alias("tag")))
    cuts = F.sort_array(F.concat(base.cast(cut), told.cast(cut)))
    text = F.col("_text")

    def step(acc: Column, s: Column) -> Column:
        free = s["a"] >= acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["a"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["b"]).alias("at"),
            F.when(free, F.concat(acc["out"], between, s["tag"])).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(~F.col("_row._null"), F.aggregate(cuts, start, step, rest))  # names cuts once: they are not stored
    return spans.select(*[clean.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
