"""URL filters by empirical-Bayes host reputation.

Rules on hosts and paths judge the pages they fit. Their verdicts are the labelled outcomes from which hosts get a
reputation for all other pages: the share of good outcomes of a host is shrunk, by a beta-binomial prior, to that
of its registered domain, that to its suffix, and that to all. The strength of each prior is estimated from the
spread of the groups around their parents (method of moments). A page without a rule is blocked if even the upper
bound of its host's posterior lies below ``least``: little evidence is not held against a host.

Outcomes are counted by host before anything else is shuffled; rules and suffixes are configuration, folded into
the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import written
from corrobora.session import broadcast_checked

Rule = tuple[str, str]  # verdict and host/path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# First "://", then the host up to "/", "?" or "#", then the path up to "?" or "#".
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
STRENGTH = (1.0, 1000.0)  # bounds of a prior's strength, in outcomes


def host_of(url: Column) -> Column:
    """Host with A-Z in lower case; empty without "://" or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null; of equal lengths that of the longer host.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    longest_last = sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[1]))
    for verdict, rule in longest_last:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.named_struct(F.lit("rule"), F.lit(rule), F.lit("verdict"), F.lit(verdict))).otherwise(out)
    return out


def registered_domain(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    """The last two labels of a host, or three under a suffix of two labels; a host of numbers is its own domain."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    domain = F.when(two.isin(*long_suffixes), three).otherwise(two) if long_suffixes else two
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(domain)


def suffix(domain: Column) -> Column:
    """What follows the first label of a registered domain; empty for a single label or numbers."""
    return F.when(domain.rlike(r"^[0-9.]*$"), "").otherwise(F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1))


def _shrunk(groups: DataFrame, name: str) -> tuple[DataFrame, float]:
    """``groups`` (n, good, parent) with the posterior mean ``name``, and the strength of the prior."""
    p, m = F.col("good") / F.col("n"), F.col("parent")
    spread = (p - m) * (p - m) / (m * (1 - m)) - 1 / F.col("n")
    over, of = groups.where("n > 0").agg(F.sum(F.col("n") * spread), F.sum(F.col("n") - 1)).first()
    rho = over / of if of else 0.0
    low, high = STRENGTH
    strength = high if rho <= 0 else min(high, max(low, 1 / rho - 1))
    return groups.withColumn(name, (F.col("good") + strength * m) / (F.col("n") + strength)), strength


def reputations(outcomes: DataFrame, long_suffixes: tuple[str, ...] = (), z: float = 1.645) -> DataFrame:
    """Per host (host, n, good): posterior mean ``reputation`` and its bounds ``low`` and ``high``.

    All hosts are listed, also those without an outcome (n = 0): they get their domain's mean and a wide band.
    """
    hosts = written(
        outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        .withColumn("domain", registered_domain(F.col("host"), long_suffixes)).withColumn("suffix", suffix(F.col("domain"))),
        "hosts",
    )
    total, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    counts = lambda key: hosts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes, _ = _shrunk(counts(["suffix"]).withColumn("parent", F.lit((good + 1) / (total + 2))), "of_suffix")
    domains = counts(["domain", "suffix"]).join(broadcast_checked(suffixes.select("suffix", F.col("of_suffix").alias("parent"))), "suffix")
    domains, _ = _shrunk(domains, "of_domain")
    hosts = hosts.join(broadcast_checked(domains.select("domain", F.col("of_domain").alias("parent"))), "domain")
    hosts, strength = _shrunk(hosts, "reputation")
    mean, size = F.col("reputation"), F.col("n") + strength
    band = z * F.sqrt(mean * (1 - mean) / (size + 1))
    return hosts.select(
        "host", "n", "good", "reputation", F.greatest(mean - band, F.lit(0.0)).alias("low"), F.least(mean + band, F.lit(1.0)).alias("high")
    )


def judge(
    pages: DataFrame, rules: list[Rule], url: str = "url", long_suffixes: tuple[str, ...] = (), least: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null without one) and ``verdict`` ("allow" or "block").

    A null url, or one without "://", has an empty host and path; such pages share one reputation, which no rule
    informs. Repeated rows count as outcomes of their own. Columns of ``pages`` named like the new ones are
    replaced. Without any rule every page is allowed.
    """
    new = ["host", "path", "rule", "verdict"]
    at = F.col(url).cast("string")
    split = pages.select(
        F.struct(*[c for c in pages.columns if c.lower() not in new]).alias("row"), host_of(at).alias("host"), path_of(at).alias("path")
    )
    found = split.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    good = F.when(F.col("found.verdict") == "allow", 1).otherwise(0)
    outcomes = found.groupBy("host").agg(F.count("found.rule").alias("n"), F.sum(good).alias("good"))
    known = reputations(outcomes, long_suffixes, z).select("host", "high")
    method = F.when(F.col("high") < least, "block").otherwise("allow")
    return found.join(broadcast_checked(known), "host").select(
        "row.*", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict")
    )
