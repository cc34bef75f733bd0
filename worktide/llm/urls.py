"""URL filters by pattern rules, indexed by their rarest literal token.

A rule is a verdict and a pattern over the host and path, or over the whole URL:

* ``||example.org/news/``: that host or a subdomain, with a path that starts so;
* anything else may match anywhere in the URL; ``*`` is any run of characters, ``^`` a separator
  (no letter or digit) or the end; capitals and small letters are equal.

Tokens are runs of ASCII letters and digits. A token that every match must contain as a whole is a
literal of the rule. The literal found in the fewest URLs of the table indexes the rule; a rule
without literals stands under the empty token, which every URL has. The distinct URLs' tokens are
joined with the index, and only rules met so run their regular expression. All work is DataFrame
functions.

Of the host rules that match, the longest wins, then the blocking one. A URL without one is judged
by the other rules: an allowing rule wins over blocking ones, and without any match it is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path, so no host rule fits
it; a null URL is allowed. Repeated URLs get equal verdicts and are judged once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.operators.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A pattern and its verdict (allow or block)."""

    pattern: str
    verdict: str

    @property
    def by_host(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    @property
    def regex(self) -> str:
        if self.by_host:
            host, slash, path = self.name.partition("/")
            return "^(?:[^/]*\\.)?" + _literal(host.lower()) + ("" if slash else "(?=/|$)") + _literal(slash + path)
        parts = re.split(r"([*^])", self.pattern)
        kinds = {"*": "(?s:.*)", "^": "(?:[^A-Za-z0-9]|$)"}
        return "(?i)" + "".join(kinds.get(p) or _literal(p) for p in parts)

    @property
    def literals(self) -> list[str]:
        """Tokens that are whole in every match: what stands beside them ends a token."""
        text = self.name.lower()
        found = []
        for m in _TOKEN.finditer(text):
            before = text[m.start() - 1] if m.start() else ("." if self.by_host else "*")
            after = text[m.end()] if m.end() < len(text) else "*"
            if self.by_host and "/" not in text and m.end() == len(text):
                after = "/"
            if before != "*" and after != "*":
                found.append(m.group())
        return found


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


# What is blocked or allowed by default, beside a user's own host rules (a fixed policy).
DEFAULT_RULES = (
    Rule("^casino^", "block"),
    Rule("^cheap^pills^", "block"),
    Rule("^free^bets^", "block"),
    Rule("^spam^farm^", "block"),
    Rule("^ads^track^", "block"),
    Rule("^adult^", "block"),
    Rule("^porn^", "block"),
    Rule("^viagra^", "block"),
    Rule("^payday^loan", "block"),
    Rule("^doubleclick^", "block"),
    Rule("^adserver^", "block"),
    Rule("^addiction^help^", "allow"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host in small letters and path; both empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def tokens(text: Column) -> Column:
    """Distinct tokens and the empty one."""
    return F.array_distinct(
        F.concat(F.array(F.lit("")), F.split(lower_ascii(text), "[^a-z0-9]+"))
    )


def _table(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (r.pattern, r.name, r.verdict, r.by_host, len(r.name), r.regex, r.literals or [""])
        for r in dict.fromkeys(rules)
    ]
    return spark.createDataFrame(
        rows,
        "pattern string, name string, verdict string, by_host boolean, size int, regex string, "
        "literals array<string>",
    )


def index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with the literal ``token`` that is in the fewest of all ``urls`` (column ``tokens``)."""
    # Written, so that its size decides how Spark joins it.
    wanted = stage(rules.select(F.explode("literals").alias("token")).distinct())
    counted = (
        urls.select(F.explode("tokens").alias("token"))
        .join(wanted, "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        rules.select("pattern", "verdict", F.explode("literals").alias("token"))
        .join(counted, "token", "left")
        .groupBy("pattern", "verdict")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    )
    return rules.drop("literals").join(rarest, ["pattern", "verdict"])


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (name of the host rule), pattern (the rule that decided) and
    verdict. Columns of these names are replaced."""
    spark = pages.sparkSession
    added = ("host", "path", "rule", "pattern", "verdict")
    kept = [c for c in pages.columns if c not in added or c == url]
    host, path = host_and_path("url")
    urls = (
        pages.select(F.col(url).alias("url")).where("url is not null").distinct()
        .select("url", F.concat(host, path).alias("place"))
    )
    urls = stage(urls.withColumn("tokens", F.array_union(tokens(F.col("url")), tokens(F.col("place")))))
    indexed = stage(index(urls, _table(spark, rules)))
    met = urls.select("url", "place", F.explode("tokens").alias("token")).join(indexed, "token")
    fits = F.regexp_like(F.when(F.col("by_host"), F.col("place")).otherwise(F.col("url")), F.col("regex"))
    order = F.struct(
        F.col("by_host"),
        F.when(F.col("by_host"), F.col("size")).otherwise(0),
        (F.col("verdict") == F.when(F.col("by_host"), F.lit("block")).otherwise(F.lit("allow"))),
        F.col("size"),
        F.col("pattern"),
    )
    decided = (
        met.where(fits)
        .groupBy("url")
        .agg(F.max_by(F.struct("name", "pattern", "verdict", "by_host"), order).alias("__won"))
        .select(F.col("url").alias("__url"), "__won")
    )
    host, path = host_and_path(url)
    return (
        pages.select(*kept)
        .join(decided, F.col(url) == F.col("__url"), "left")
        .select(
            *kept,
            host.alias("host"),
            path.alias("path"),
            F.when(F.col("__won.by_host"), F.col("__won.name")).alias("rule"),
            F.col("__won.pattern").alias("pattern"),
            F.coalesce("__won.verdict", F.lit("allow")).alias("verdict"),
        )
    )


def keep(pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, url: str = "url") -> DataFrame:
    """Rows whose URL is allowed, with their columns."""
    columns = pages.columns
    own = pages.select(F.struct(*columns).alias("__row"), F.col(url).alias("__own"))
    return judge(own, rules, "__own").where("verdict = 'allow'").select("__row.*")
