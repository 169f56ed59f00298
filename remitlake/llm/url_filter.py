"""URL filtering: host and path rules first, then wildcard patterns found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules on host and path; a rule fits its host and all subdomains if the path starts with the rule's.
SITE_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
#: Patterns that block. ``*`` stands for any run, ``^`` for one character that isn't a letter, digit or one of ``_-.%``,
#: or the end; ``||`` at the start for the beginning of a host or of a part of it; ``|`` at either end for that end.
PATTERNS = (
    "^utm_source=feed^", "^utm_campaign=", "^sessionid=", "^phpsessid=", "^jsessionid=", "^page=*&ref=", "^replytocom=",
    "||ads.", "||doubleclick.net^", "||tracker.", "/ads/", "/banner/*.gif|", "/login^", "/signin^", "/signup^", "/cart^",
    "/checkout^", "/wp-admin/", "/tag/*/page/", "/feed/|", "/print/*.html|", "^action=edit^", "^share=", "/cgi-bin/",
    "||m.*/es/*#top|",
)
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[?#]|\Z", rest).start()
    slash = rest.find("/", 0, end)
    slash = end if slash < 0 else slash
    return rest[:slash].translate(_UPPER), rest[slash:end]


def site_rule(host: str, path: str, rules: dict[str, dict[str, str]]) -> tuple[str, str] | None:
    """The longest rule that fits, with its verdict. ``rules``: host -> path -> verdict."""
    best = None
    name = host
    while name:
        for start, verdict in rules.get(name, {}).items():
            if path.startswith(start) and (best is None or len(name + start) > len(best[0])):
                best = (name + start, verdict)
        name = name.partition(".")[2]
    return best


class Pattern(NamedTuple):
    text: str
    regex: str
    tokens: tuple[str, ...]


def compile_pattern(text: str) -> Pattern:
    """The regular expression of a pattern over lower-cased URLs, and the tokens every URL that it matches must have:
    its runs of letters and digits that the pattern delimits on both sides."""
    body, head, tail = text.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}
    regex = head + "".join(parts.get(c, re.escape(c)) for c in body) + tail
    padded = ("/" if head else "*") + body + ("/" if tail else "*")
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", padded)
    return Pattern(text, regex, tuple(dict.fromkeys(tokens)))


def url_tokens(url: str) -> set[str]:
    return set(re.findall("[a-z0-9]+", url))


class PatternIndex:
    """Patterns filed under the rarest of their tokens; those without a token are tried on every URL."""

    def __init__(self, patterns: list[Pattern], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[str, re.Pattern]]] = {}
        self.always: list[tuple[str, re.Pattern]] = []
        for p in patterns:
            entry = (p.text, re.compile(p.regex, re.DOTALL))
            if p.tokens:
                rarest = min(p.tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def find(self, url: str) -> str | None:
        """The first pattern, in the order of their texts, that matches."""
        low = url.lower()
        found = [text for text, regex in self.always if regex.search(low)]
        for token in url_tokens(low) & self.by_token.keys():
            found.extend(text for text, regex in self.by_token[token] if regex.search(low))
        return min(found, default=None)


def token_counts(pages: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """In how many URLs of ``pages`` each of ``tokens``, a list bounded by the patterns, occurs."""
    words = F.array_distinct(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"))
    wanted = F.array(*[F.lit(t) for t in sorted(tokens)])
    found = pages.select(F.explode(F.array_intersect(words, wanted)).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
    site_rules: tuple[tuple[str, str], ...] = SITE_RULES, patterns: tuple[str, ...] = PATTERNS,
) -> DataFrame:
    """Verdict on every URL: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``pattern``.

    The longest site rule that fits decides. Where none fits, a URL that matches a pattern is blocked (``pattern`` names the
    first in the order of their texts), any other is allowed. One row per input row, no shuffle of the pages; both rule
    lists are parameters and go to the tasks whole. Null URLs and those without ``://`` have empty host and path; a null
    URL is allowed. Null and repeated ids are kept as they are. No rows in, none out; other columns are not read.
    """
    compiled = [compile_pattern(p) for p in patterns]
    tokens = {t for p in compiled for t in p.tokens}
    counts = token_counts(pages, tokens, url_col) if tokens else {}
    by_host: dict[str, dict[str, str]] = {}
    for rule, verdict in site_rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host, {})["/" + path] = verdict

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PatternIndex(compiled, counts)
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = site_rule(host, path, by_host)
                pattern = None if rule or url is None else index.find(url)
                out.append((host, path, rule[0] if rule else None, rule[1] if rule else "block" if pattern else "allow", pattern))
            columns = [pa.array([o[j] for o in out], pa.string()) for j in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=[id_col, "host", "path", "rule", "verdict", "pattern"]
            )

    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op6_sql() -> str:
    """The same verdicts with every pattern tried on every URL."""
    rules = ", ".join(f"({_quoted(r.partition('/')[0])}, {_quoted('/' + r.partition('/')[2])}, {_quoted(r)}, {_quoted(v)})" for r, v in SITE_RULES)
    patterns = ", ".join(f"({_quoted(p)}, {_quoted(compile_pattern(p).regex.replace(chr(92) + 'Z', chr(92) + 'z'))})" for p in PATTERNS)
    return f"""
WITH site(rule_host, rule_path, rule, verdict) AS (VALUES {rules}),
patterns(pattern, regex) AS (VALUES {patterns}),
rest AS (
    SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, url,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), urls AS (SELECT DISTINCT url, host, path FROM parts),
fits AS (
    SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM urls JOIN site ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY url
), hits AS (SELECT url, min(pattern) AS pattern FROM urls JOIN patterns ON regexp_matches(lower(url), regex, 's') GROUP BY url)
SELECT page_id, host, path, f.rule,
       coalesce(f.verdict, CASE WHEN h.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN f.rule IS NULL THEN h.pattern END AS pattern
FROM parts p LEFT JOIN fits f ON p.url = f.url LEFT JOIN hits h ON p.url = h.url
"""
