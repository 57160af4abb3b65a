"""URL filter by empirical-Bayes host reputation.

Labelled pages give each host good and bad outcomes. A host's good share has a
beta prior whose mean is that of its registered domain, whose prior is that of
its suffix, whose prior is the share of all labelled pages; each level's prior
strength comes from the spread of its own counts (moments of the beta-binomial).
A url is blocked if even the upper bound of its host's posterior is below a limit.
Explicit rules (host and path prefix) come first; the longest that fits wins.

Scale: outcomes are partially aggregated sums by host, then by domain and suffix; pages
meet the table of distinct hosts in one join of two plain exchanges, split by
adaptive execution where a host is hot. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Suffixes of more than one label, after which the registered domain begins, unless a caller passes its own (such as a public suffix list).
LONG_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.tw", "com.hk", "com.sg",
    "com.mx", "com.ar", "com.tr", "co.kr", "co.in", "co.id", "co.il", "co.za", "com.ua", "com.pl", "github.io", "blogspot.com",
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", "")


def host_suffix(name: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    """The longest of ``suffixes`` that the name ends in, at a dot; else its last label."""
    labels = F.split(name, r"\.")
    ends = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n)), ".")
    out = F.substring_index(name, ".", -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        out = F.when(ends(n).isin([s for s in suffixes if s.count(".") + 1 == n]), ends(n)).otherwise(out)
    return out


def registered_domain(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it; a host without such a label is its own domain."""
    head = F.substr(host, F.lit(1), F.greatest(F.lit(0), F.char_length(host) - F.char_length(suffix) - 1))
    return F.when(head == "", host).otherwise(F.concat(F.substring_index(head, ".", -1), F.lit("."), suffix))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Rules: ("allow" or "block", "host/path")."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(level: DataFrame, mean: str) -> float:
    """Prior strength (alpha + beta) of a level, from the moments of its counts around their prior means."""
    m = F.col(mean)
    got = level.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * m, 2)).alias("spread"), F.sum(F.col("n") * m * (1 - m)).alias("binomial"), F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("pairs")
    ).first()
    rho = (got.spread - got.binomial) / got.pairs if got.pairs else 0.0
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.64, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """(host, n, good, mean, lower, upper) for every distinct host of ``hosts``.

    Domain and suffix leave a host's user and port out; the host itself keeps them. ``outcomes`` has host and good (0 or 1; null: unlabelled, not counted). Hosts without outcomes
    keep their domain's prior; with no outcomes at all the mean is one half. A null host is passed over, repeated ones count once, the empty host is a host; no hosts give no rows.
    """
    scratch = Scratch(hosts.sparkSession, "hosts")
    counted = outcomes.filter("good is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    names = hosts.select("host").distinct()
    table = names.join(counted, "host", "left").fillna(0, ["n", "good"]).withColumn("suffix", host_suffix(host_name(F.col("host")), suffixes))
    table = scratch.keep(table.withColumn("domain", registered_domain(host_name(F.col("host")), F.col("suffix"))))
    total = table.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (total.good + 1) / (total.n + 2) if total.n else 0.5

    ends = scratch.keep(table.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(float(overall))))
    s = _strength(ends, "prior")
    ends = ends.select("suffix", ((F.col("prior") * s + F.col("good")) / (s + F.col("n"))).alias("prior"))
    domains = scratch.keep(table.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(ends, "suffix"))
    s = _strength(domains, "prior")
    domains = domains.select("domain", ((F.col("prior") * s + F.col("good")) / (s + F.col("n"))).alias("prior"))
    table = scratch.keep(table.join(domains, "domain"))
    s = _strength(table, "prior")
    alpha, beta = F.col("prior") * s + F.col("good"), (1 - F.col("prior")) * s + F.col("n") - F.col("good")
    mean, spread = alpha / (alpha + beta), F.sqrt(alpha * beta / (F.pow(alpha + beta, 2) * (alpha + beta + 1)))
    return table.select("host", "n", "good", mean.alias("mean"), F.greatest(F.lit(0.0), mean - z * spread).alias("lower"), F.least(F.lit(1.0), mean + z * spread).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, z: float = 1.64, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's posterior.

    ``outcomes`` holds (page_id, good). Null urls and urls without ``://`` have empty host and
    path; they form one host of their own. Repeated page ids in ``pages`` stay as rows; each of
    their outcomes counts. Other columns are ignored. An empty table gives no rows.
    """
    split = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labelled = split.join(outcomes.select("page_id", "good"), "page_id").select("host", "good")
    reputation = Scratch(pages.sparkSession, "reputation").keep(host_reputation(split, labelled, z, suffixes))
    joined = split.join(reputation, "host").withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("upper") < limit, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.col("n").alias("host_labels"), F.col("good").alias("host_good"), F.col("mean").alias("host_mean"), F.col("lower").alias("host_lower"), F.col("upper").alias("host_upper"))
