"""URL filter by empirical-Bayes host reputation, with DataFrame functions.

Labelled page outcomes are counted per host, registered domain and public suffix.  Each level has a beta prior around its parent's
posterior mean; the prior's strength comes from the outcomes by the method of moments for beta-binomial counts.
A host is blocked when the upper bound of its posterior share of good pages is below ``min_good``: it takes
evidence to block a host, and a host without labels has its domain's reputation.  Fixed rules come before the method.

Cases: a null url or one without ``://`` has an empty host and path, and the reputation of the empty host; outcomes of
unknown pages and null outcomes are not counted; several outcomes of a page vote (a tie counts as good); repeated page rows are
judged row by row and counted once each; no outcomes at all allow every url; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import sized
from lyceum.sources.staging import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The rules, as (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za"]
MIN_GOOD = 0.75
Z = 1.645


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Public suffix of a host, without user and port."""
    name = F.regexp_extract(host, "^(?:[^@]*@)?([^:]*)", 1)
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label before it."""
    name = F.regexp_extract(host, "^(?:[^@]*@)?([^:]*)", 1)
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def _shrunk(level: DataFrame) -> DataFrame:
    """``level(m, n, g)`` with the posterior's ``a`` and ``b`` around the parent's mean ``m``; one row gives the prior's strength."""
    v = F.col("m") * (1 - F.col("m"))
    excess = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("g") / F.col("n") - F.col("m"), F.lit(2)) - v))
    room = F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * v))
    rho = F.coalesce(F.when(room > 0, excess / room), F.lit(0.0))
    k = 1 / level.agg(F.greatest(F.lit(0.001), F.least(F.lit(0.5), rho))).first()[0] - 1
    return level.withColumn("a", k * F.col("m") + F.col("g")).withColumn("b", k * (1 - F.col("m")) + F.col("n") - F.col("g"))


def _mean(level: DataFrame, key: str) -> DataFrame:
    return level.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))


def hosts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every host of ``pages(page_id, url)`` with its posterior ``a``, ``b`` from ``outcomes(page_id, good)``; staged."""
    votes = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(
        (F.avg(F.col("good").cast("double")) >= 0.5).cast("long").alias("good")
    )
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(votes, "page_id", "left")
    host = stage(
        seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))),
        "hosts",
    )
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffix = host.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    good, seen = host.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_suffix = _shrunk(suffix.withColumn("m", F.lit((good + 1) / (seen + 2))))
    by_domain = _shrunk(domain.join(_mean(by_suffix, "suffix"), "suffix"))
    by_host = _shrunk(host.join(_mean(by_domain, "domain"), "domain"))
    return stage(by_host.select("host", "domain", "suffix", "n", "g", "a", "b"), "host-posteriors")


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, min_good: float = MIN_GOOD, z: float = Z
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's posterior ``mean`` and upper ``bound``, for every row."""
    known = hosts(pages, outcomes)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    bounds = known.select(F.col("host").alias("h"), mean.alias("mean"), F.least(F.lit(1.0), mean + z * sd).alias("bound"), "n")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when((F.col("bound") < min_good) & F.lit(labelled > 0), "block").otherwise("allow")
    return split.join(sized(bounds, 100), split.host == bounds.h).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict")
    )
