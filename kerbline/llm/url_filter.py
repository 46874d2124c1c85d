"""URL filter with rules and empirical-Bayes host reputation (operator 4).

Labelled page outcomes (1 bad, 0 good) are counted by host, registered domain and suffix. The share of bad pages is
shrunk through beta-binomial priors from the top down: a suffix towards all pages, a registered domain towards its
suffix, a host towards its registered domain. The strength of each prior is estimated from the data, from how
much the children differ beyond what their counts explain. A host is blocked when a lower bound of its posterior is
above ``BLOCK_SHARE``; a host without outcomes has the prior of the first level that has some.

Rules win over reputation. A rule fits its host and all subdomains if the path starts with the rule's; of those
that fit the longest wins. Null urls and urls without ``://`` have an empty host and path, whose reputation is that of
such pages. Counts are combined before the shuffle; the table of hosts is broadcast only when it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import stored

#: Mean and deviations: the lower bound is the posterior mean minus so many posterior deviations.
BOUND_DEVIATIONS = 1.64
BLOCK_SHARE = 0.3
#: The correlation between the pages of a child is kept in this range, so that a prior counts as 2 to 999 pages: hosts
#: that are each of one kind do not let a single outcome decide.
CORRELATION = (0.001, 1 / 3)
HOST_ROWS_BROADCAST = 100_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; all others count as one label. A parameter of the operator.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.uk")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, verdict)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix; a numeric address is its own."""
    last_two = F.substring_index(host, ".", -2)
    named = F.when(last_two.isin(*two_label), last_two).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(named)


def domain_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and the label in front of it."""
    last_two = F.substring_index(host, ".", -2)
    named = F.when(last_two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(last_two)
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(named)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: (len(rule.text), rule.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def strength(children: DataFrame) -> DataFrame:
    """One row ``strength``: pseudo-counts of the prior of ``children`` (``bad, pages, mean``), by the analysis of variance.

    The correlation of outcomes within a child is what its counts differ from the parent's mean beyond chance.
    """
    pages, mean = F.col("pages"), F.col("mean")
    chance = F.sum(mean * (1 - mean))
    spread = F.sum(pages * F.pow(F.col("bad") / pages - mean, 2))
    noise = F.sum(pages * mean * (1 - mean)) - chance
    correlation = F.when(noise > 0, (spread - chance) / noise).otherwise(0.0)
    low, high = CORRELATION
    correlation = F.greatest(F.least(correlation, F.lit(high)), F.lit(low))
    return children.agg(F.coalesce(1 / correlation - 1, F.lit(1 / low - 1)).alias("strength"))


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, alpha, beta`` of the posterior of each row of ``hosts`` (column ``host``), from ``outcomes`` (``host, bad``).

    Without any outcome, the share of bad pages is taken as 0.
    """
    by_host = outcomes.groupBy("host").agg(F.sum("bad").alias("bad"), F.count("bad").alias("pages")).where("pages > 0")
    by_host = stored(by_host.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    total = by_host.agg(F.sum("bad"), F.sum("pages")).first()
    overall = total[0] / total[1] if total[1] else 0.0

    def level(key: str) -> DataFrame:
        return by_host.groupBy(key).agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))

    def strength_of(children: DataFrame) -> float:
        return strength(children).first()[0]

    suffixes = level("suffix").withColumn("mean", F.lit(overall))
    m = strength_of(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("bad") + m * overall) / (F.col("pages") + m)).alias("suffix_mean"))
    domains = by_host.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
    domains = domains.join(suffixes, "suffix").withColumn("mean", F.col("suffix_mean"))
    m = strength_of(domains)
    domains = domains.select("domain", ((F.col("bad") + m * F.col("mean")) / (F.col("pages") + m)).alias("domain_mean"))
    m = strength_of(by_host.join(domains, "domain").withColumn("mean", F.col("domain_mean")))
    known = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    known = known.join(by_host.select("host", "bad", "pages"), "host", "left")
    known = known.join(domains, "domain", "left").join(suffixes, "suffix", "left")
    mean = F.coalesce("domain_mean", "suffix_mean", F.lit(overall))
    bad, pages = F.coalesce("bad", F.lit(0)), F.coalesce("pages", F.lit(0))
    return known.select("host", (bad + m * mean).alias("alpha"), (pages - bad + m * (1 - mean)).alias("beta"))


def blocked(alpha: Column, beta: Column, share: float = BLOCK_SHARE) -> Column:
    """The lower posterior bound of the share of bad pages is above ``share``."""
    total = alpha + beta
    deviation = F.sqrt(alpha * beta / (total * total * (total + 1)))
    return alpha / total - BOUND_DEVIATIONS * deviation > share


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``id, host, path, rule, verdict`` per row of ``pages``; ``outcomes`` holds ``host`` and ``bad`` (0, 1 or null)."""
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = stored(parts.select("host").distinct(), "page-hosts")
    verdicts = stored(
        reputations(hosts, outcomes).select(
            F.col("host").alias("of_host"), F.when(blocked(F.col("alpha"), F.col("beta")), "block").otherwise("allow").alias("reputation")
        ),
        "host-verdicts",
    )
    if verdicts.count() <= HOST_ROWS_BROADCAST:
        verdicts = F.broadcast(verdicts)
    rule, rule_verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    joined = parts.join(verdicts, F.col("host") == F.col("of_host"))
    return joined.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(rule_verdict, "reputation").alias("verdict"))
