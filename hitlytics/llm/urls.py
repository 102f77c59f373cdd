"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` together with literal tokens that every match contains as whole tokens.
Token counts over all URLs choose each rule's rarest one as its key; a URL's tokens fetch the rules under them, and only
those run their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What separates tokens in a subject.
BREAKS = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`precedence`: the matching rule with the highest one decides; `named` rules are reported by name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    precedence: int
    named: bool = False


def prefix_rule(name: str, verdict: str) -> Rule:
    """host/path: fits the host and its subdomains where the path starts with the rule's; the longest wins."""
    host, slash, path = name.partition("/")
    literals = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", host + slash + path)
    return Rule(name, verdict, r"^(?:[^/]*\.)?" + re.escape(host + slash + path), tuple(x.lower() for x in literals),
                1000 + len(name), True)


#: The registered base rules.
BASE_RULES = [
    prefix_rule("org/", "allow"),
    prefix_rule("example.org/es/", "block"),
    prefix_rule("example.org/en/1", "block"),
    prefix_rule("com/fr/", "allow"),
    prefix_rule("com/de/", "block"),
]

#: Kinds of sites that a text corpus leaves out (name, pattern, tokens every match has).
SITE_RULES = [
    Rule(name, "block", pattern, tokens, 10)
    for name, pattern, tokens in [
        ("casino", r"^(?:[^/]*[.-])?casino(?:-[a-z0-9]+)?\.", ("casino",)),
        ("bets", r"^(?:[^/]*\.)?free-bets\.", ("free", "bets")),
        ("poker", r"^(?:[^/]*[.-])?poker(?:-[a-z0-9]+)?\.", ("poker",)),
        ("adult", r"^(?:[^/]*[.-])?adult(?:-[a-z0-9]+)?\.", ("adult",)),
        ("xxx", r"^(?:[^/]*[.-])?xxx[.-]", ("xxx",)),
        ("pills", r"^(?:[^/]*\.)?cheap-pills\.", ("cheap", "pills")),
        ("spam", r"^(?:[^/]*[.-])?spam(?:-[a-z0-9]+)?\.", ("spam",)),
        ("ads", r"^(?:[^/]*[.-])?ads(?:-[a-z0-9]+)?\.", ("ads",)),
        ("track", r"^(?:[^/]*[.-])?track\.", ("track",)),
    ]
]


def host_of(url: F.Column) -> F.Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """After the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with its rarest literal token by the counts of `tokens`; ties go to the first in order."""
    literals = rules.select("name", F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    ranked = literals.join(counts, "token", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("key"))
    return rules.join(ranked, "name").select(F.col("key.token").alias("token"), "name", "verdict", "pattern", "precedence", "named")


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): one row per row of `pages`.

    The matching rule of highest precedence decides; without one the verdict is allow. rule is null unless the deciding
    rule is a named one. Null URLs and those without `://` have empty host and path, and are allowed. Each different URL
    is judged once, however often it occurs. A rule without a literal token is refused, since it could not be indexed.
    """
    bare = [r.name for r in rules if not r.tokens]
    if bare:
        raise ValueError(f"rules without a literal token: {bare}")
    spark = pages.sparkSession
    book = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.precedence, r.named) for r in rules],
                                 "name string, verdict string, pattern string, tokens array<string>, precedence int, named boolean")
    url = F.col("url")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    subjects = rows.filter(url.isNotNull()).select("url").distinct().withColumn("subject", F.concat(host_of(url), path_of(url)))
    tokens = subjects.select("url", "subject", F.explode(F.array_distinct(F.split(F.lower("subject"), BREAKS))).alias("token"))
    matched = tokens.join(index(book, tokens.select("token")), "token").filter(F.expr("subject rlike pattern"))
    best = matched.groupBy("url").agg(F.max(F.struct("precedence", "name", "verdict", "named")).alias("best"))
    return rows.join(best, "url", "left").select(
        "id", host_of(url).alias("host"), path_of(url).alias("path"),
        F.when(F.col("best.named"), F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
