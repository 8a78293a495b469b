"""URL rules found by their rarest literal token. Native: DataFrame functions only.

Each rule becomes a regular expression over host and path and a set of literal tokens that every fitting
url must contain. A rule is indexed under the token that the fewest urls contain; a url fetches only the
rules indexed under its own tokens, and only those are matched.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklayout.llm.common import lower_ascii
from sparklayout.sources.work import materialize


class Rule(NamedTuple):
    """``action`` urls of ``host`` and its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        """Regular expressions for the host and for the path."""
        return rf"^(?s:.*\.)?{re.escape(self.host)}\z", rf"^{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Host labels, and those path segments that are complete: a slash follows them."""
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return labels + [f"p:{x}" for x in self.path.split("/")[1:-1] if x]


#: Rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: The token of rules that have no other; every url has it.
ANY = "*"
#: What is broadcast: rules up to this many; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ANY))))


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Of the fitting rules the one with the longest text wins; equal lengths go to block before allow, then
    to the lesser text. Without a fitting rule (also: null url, no ``://``) ``rule`` is null and the
    verdict is ``default``. Columns of these names that ``pages`` already has are replaced. Each url is
    judged once, however many rows have it. Repeated rows stay repeated.
    """
    spark = pages.sparkSession
    rules = list(dict.fromkeys(rules))
    pages = pages.drop("host", "path", "rule", "verdict")
    parts = {"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}
    urls = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    tokens = urls.select("_url", "_host", "_path", F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("_token"))

    known = spark.createDataFrame(
        [(i, r.action, r.text, *r.patterns, t) for i, r in enumerate(rules) for t in (r.tokens or [ANY])],
        "_rule int, _action string, _text string, _of_host string, _of_path string, _token string",
    )
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    # how many urls contain each token that some rule has: one row a token
    held = tokens.join(hint(known.select("_token").distinct()), "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    index = (
        known.join(held, "_token")
        .groupBy("_rule", "_action", "_text", "_of_host", "_of_path")
        .agg(F.min_by("_token", F.struct("_n", "_token")).alias("_token"))
    )
    # a rule with a token that no url contains fits no url; min over its present tokens keeps it harmless
    hits = tokens.join(hint(index), "_token").where("_host rlike _of_host and _path rlike _of_path")
    best = hits.groupBy("_url").agg(
        F.min_by(
            F.struct("_text", "_action"),
            F.struct(-F.length("_text"), F.when(F.col("_action") == "block", 0).otherwise(1), F.col("_text")),
        ).alias("_best")
    )
    best = materialize(best, "url_rules")  # so that a url that many rows have, or none, is split by adaptive execution
    return (
        pages.join(best, F.col(url_col) == F.col("_url"), "left")
        .withColumns(parts)
        .withColumn("rule", F.col("_best._text"))
        .withColumn("verdict", F.coalesce("_best._action", F.lit(default)))
        .drop("_url", "_best")
    )
