"""URL filters: rules by host and path, and the reputation of hosts elsewhere.

Method: empirical-Bayes host reputation. Labelled outcomes of pages are counted per host; a
beta-binomial prior is fitted for suffixes over all of them, for registered domains from their
suffix and for hosts from their domain, so that little evidence shrinks towards the level
above. A host is blocked when its rate of bad pages is above a limit with a posterior probability
of SURE: when the posterior's lower quantile is. All of it is DataFrame operations; counts are pre-aggregated per host, so no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motioncheck.llm import shared

#: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The probability with which a host's bad rate must be above the limit, and the limit.
SURE, LIMIT = 0.975, 0.5
#: Steps of the integral of the posterior.
GRID = 200
#: Second labels under which a country's domains are registered.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: The strength of a prior in outcomes: at least and at most, about.
STRENGTH = (2.0, 200.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null if none fits."""
    out = None
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + prefix).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain of a host, and its suffix: the last label, or two of them in a country with second labels.

    User names and ports are no part of either; an address of numbers is its own domain.
    """
    name = F.rtrim(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), F.lit("."))
    labels = F.split(name, "[.]")
    two = (F.size(labels) >= 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND)
    whole = F.rlike(name, F.lit("^[0-9.]+$|^\\[")) | (F.size(labels) == 1)
    suffix = F.when(whole, name).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(whole, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return domain, suffix


def _digamma(x: Column) -> Column:
    y = x + 6
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - sum((1 / (x + i) for i in range(6)), F.lit(0.0))


def _trigamma(x: Column) -> Column:
    y = x + 6
    return 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) - 1 / (30 * y * y * y * y * y) + sum((1 / ((x + i) * (x + i)) for i in range(6)), F.lit(0.0))


def _bound(values: Column, use: Callable[[Column], Column]) -> Column:
    """use() of a struct that is evaluated once, however often use() names its fields."""
    return F.get(F.transform(F.array(values), use), 0)


def surely_above(a: Column, b: Column, limit: float) -> Column:
    """The probability that a beta variable is above the limit.

    By the trapezoid rule over its logit, whose density is smooth whatever a and b are: it has the
    mean digamma(a) - digamma(b), and next to nothing lies ten deviations away. What the steps of
    the integral share is bound before, so that a step costs two exponentials and a logarithm.
    """

    def integral(v: Column, start: Column, end: Column) -> Column:
        density = lambda u: F.exp(v.a * u - v.n * F.log1p(F.exp(u)) - v.peak)

        def over(x: Column) -> Column:
            inner = F.aggregate(F.sequence(F.lit(1), F.lit(GRID - 1)), F.lit(0.0), lambda total, i: total + density(x.start + i * x.step))
            return x.step * (inner + (density(x.start) + density(x.end)) / 2)

        return _bound(F.struct(start.alias("start"), end.alias("end"), ((end - start) / GRID).alias("step")), over)

    def halves(v: Column) -> Column:
        low, high = v["mean"] - 10 * v.deviation, v["mean"] + 10 * v.deviation
        cut = F.least(high, F.greatest(low, F.lit(math.log(limit / (1 - limit)))))
        return _bound(F.struct(integral(v, low, cut).alias("below"), integral(v, cut, high).alias("beyond")), lambda x: x.beyond / (x.below + x.beyond))

    def shared_values(v: Column) -> Column:
        peak = v.a * F.log(v.a / v.b) - (v.a + v.b) * F.log1p(v.a / v.b)
        return F.struct(v.a.alias("a"), (v.a + v.b).alias("n"), peak.alias("peak"), (_digamma(v.a) - _digamma(v.b)).alias("mean"), F.sqrt(_trigamma(v.a) + _trigamma(v.b)).alias("deviation"))

    return _bound(F.struct(a.alias("a"), b.alias("b")), lambda v: _bound(shared_values(v), halves))


def reputations(outcomes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, pages, bad, rate, above) per host of outcomes (host, bad 0/1).

    rate: the posterior mean; above: the posterior probability that the rate is above the limit.
    Rows with a null outcome don't count; the empty host is a host like others.
    """
    folder = shared.workspace(outcomes.sparkSession)
    counted = outcomes.where("bad is not null and host is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("k"))
    counted = shared.written(counted, f"{folder}/hosts")
    domain, suffix = domain_and_suffix(F.col("host"))
    counted = counted.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(((F.col("k") + 1) / (F.col("n") + 2)).alias("prior"))
    # a level is written before the next one reads it
    suffixes = shared.written(_posterior(suffixes, every, []), f"{folder}/suffixes")
    domains = shared.written(_posterior(domains, suffixes, ["suffix"]), f"{folder}/domains")
    hosts = _posterior(counted, domains.select("domain", "suffix", "prior"), ["domain", "suffix"])
    return hosts.select("host", F.col("n").cast("long").alias("pages"), F.col("k").cast("long").alias("bad"), F.col("prior").alias("rate"), surely_above(F.col("a"), F.col("b"), limit).alias("above"))


def _posterior(level: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
    """level with its posterior a, b and mean (as `prior` for the level below).

    The prior's mean is the posterior mean of the level above; its strength comes by moments
    from how widely the members' rates differ, one strength per level.
    """
    joined = level.join(above.select(*on, F.col("prior").alias("m")), on) if on else level.crossJoin(F.broadcast(above.select(F.col("prior").alias("m"))))  # one row
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    # sum of (k - n m)**2 = m (1 - m) (n + n (n - 1) rho), with strength 1 / rho - 1
    spread = joined.agg(F.sum((k - n * m) * (k - n * m)).alias("x"), F.sum(m * (1 - m) * n).alias("y"), F.sum(m * (1 - m) * n * (n - 1)).alias("z"))
    rho = F.when(F.col("z") > 0, (F.col("x") - F.col("y")) / F.col("z")).otherwise(0.0)
    strength = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.when(rho > 0, 1 / rho - 1).otherwise(STRENGTH[1])))
    joined = joined.crossJoin(F.broadcast(spread.select(F.coalesce(strength, F.lit(STRENGTH[1])).alias("s"))))  # one row
    s = F.col("s")
    return joined.withColumn("a", m * s + k).withColumn("b", (1 - m) * s + n - k).withColumn("prior", (m * s + k) / (s + n)).drop("m", "s")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, limit: float = LIMIT, url: str = "url", id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_above) per row of pages.

    outcomes: (host, bad) of labelled pages. Verdict: the longest rule's; else block if
    the host's bad rate is above the limit with a probability of SURE, else allow. A host with no outcomes has null figures and
    is allowed. Null urls have an empty host and path. Rows that repeat an id are rows of
    their own; other columns are ignored, whatever their names; no rows make no rows.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    known = reputations(outcomes, limit).select(F.col("host").alias("_host"), "rate", "above")
    found = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).join(known, F.col("host") == F.col("_host"), "left")
    own = F.when(F.col("above") > SURE, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), F.col("rate").alias("bad_rate"), F.col("above").alias("bad_above"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of pages whose path ends in the number of a labelled document: bad if its quality is 0 or it is toxic.

    A null url and one without such a number have no row, nor has a page whose document isn't
    labelled. Null where the document's labels don't tell. Of labels that repeat a document the
    worst counts; pages that repeat are outcomes of their own; empty tables make no rows.
    """
    host, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    rows = pages.select(host.alias("host"), F.when(number != "", number).cast("long").alias("doc"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    known = labels.groupBy(F.col("doc_id").alias("doc")).agg(F.max(bad).alias("bad"))
    return rows.join(known, "doc").select("host", "bad")
