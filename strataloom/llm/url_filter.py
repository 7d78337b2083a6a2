"""URL filter: path rules first, then the reputation of the host by empirical Bayes.

Labelled pages give each host, registered domain and suffix a count of good outcomes. Beta-binomial priors run from the whole
table to the suffix, the registered domain and the host: each level is shrunk to the mean of the one above, with a strength
that is estimated from how much the groups of the level differ. A page is allowed while the lower bound of its host's
posterior reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
Z, THRESHOLD, MOST_STRENGTH = 1.645, 0.5, 1000.0
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _levels(df: DataFrame) -> DataFrame:
    """The registered domain (last two labels) and the suffix (last label) of each host."""
    return df.withColumns({"domain": F.regexp_extract("host", "([^.]*[.])?[^.]*$", 0), "suffix": F.regexp_extract("host", "[^.]*$", 0)})


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or one of its subdomains) and the start of a path, and its verdict; else nulls."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def _strength(groups: DataFrame) -> tuple[float, float]:
    """The mean outcome and, by the method of moments, the strength of the prior of groups(n, good); three sums reach the driver."""
    sums = groups.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("k"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("q"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2")
    ).first()
    if not sums["n"]:
        return 0.5, 1.0
    n, mean = float(sums["n"]), sums["good"] / sums["n"]
    spread = sums["q"] - n * mean * mean
    room = n - sums["n2"] / n
    var = (spread - (sums["k"] - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    return mean, min(MOST_STRENGTH, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else MOST_STRENGTH


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good, n, bound) of every host of pages(page_id, url): bound is the posterior's lower bound, rounded to 6 places."""
    outcome = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(outcome, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("quality").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))
    hosts = _levels(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    mean, at_suffix = _strength(suffixes)
    at_domain, at_host = _strength(domains)[1], _strength(hosts)[1]
    suffixes = suffixes.select("suffix", ((F.col("good") + at_suffix * mean) / (F.col("n") + at_suffix)).alias("m"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("good") + at_domain * F.col("m")) / (F.col("n") + at_domain)).alias("m"))
    a, b = F.col("good") + at_host * F.col("m"), F.col("n") - F.col("good") + at_host * (1 - F.col("m"))
    # on the scale of the arcsine a beta's spread depends on its strength alone, and a bound stays within 0 and 1
    low = F.greatest(F.lit(0.0), F.asin(F.sqrt(a / (a + b))) - Z / (2 * F.sqrt(a + b + 1)))
    bound = F.sin(low) * F.sin(low)
    return hosts.join(domains, "domain").select("host", "good", "n", F.round(bound, 6).alias("bound"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """For every row of pages(page_id, url, ...): page_id, host, path, rule, verdict, bound.

    host is what follows the first :// up to /, ? or #, with A-Z lower-cased, path what follows up to ? or #; both are empty
    for a null url or one without ://. The longest rule that fits decides; without one rule is null, and the host's posterior
    decides. Labels are outcomes of the page with their doc_id; null and other labels don't count; of several for one id the
    least does. Without labels every host gets the prior of one half. Repeated rows are judged each; an empty table gives an
    empty result; other columns are ignored.
    """
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = at.join(host_reputation(pages, labels).select("host", "bound"), "host", "left")
    own = F.when(F.col("bound") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "bound")


def _oracle() -> str:
    def fits(rule: str) -> str:
        name, _, rest = rule.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"

    by_length = sorted(RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in by_length) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in by_length) + f" WHEN bound >= {THRESHOLD} THEN 'allow' ELSE 'block' END"

    def strength(groups: str) -> str:
        return f"""(SELECT mean, CASE WHEN var > 0 THEN least({MOST_STRENGTH}, greatest(1.0, mean * (1 - mean) / var - 1)) ELSE {MOST_STRENGTH} END AS k FROM (
            SELECT mean, (q - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - n2 / n) AS var FROM (
            SELECT sum(n)::DOUBLE AS n, sum(good) / sum(n) AS mean, count(*) AS k, sum(good * good / n) AS q, sum((n * n)::DOUBLE) AS n2 FROM {groups} WHERE n > 0)))"""

    levels = "regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix"
    return f"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{SMALL}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, {levels}, count(quality)::DOUBLE AS n, coalesce(sum(quality), 0)::DOUBLE AS good FROM urls LEFT JOIN labels ON page_id = doc_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
s AS (SELECT suffix, (good + k * mean) / (n + k) AS m FROM suffixes, {strength("suffixes")}),
d AS (SELECT domain, (good + k * m) / (n + k) AS m FROM domains JOIN s USING (suffix), {strength("domains")}),
p AS (SELECT host, good + k * m AS a, n - good + k * (1 - m) AS b FROM hosts JOIN d USING (domain), {strength("hosts")}),
h AS (SELECT host, round(sin(low) * sin(low), 6) AS bound FROM (SELECT host, greatest(0.0, asin(sqrt(a / (a + b))) - {Z} / (2 * sqrt(a + b + 1))) AS low FROM p))
SELECT page_id, host, path, {rule} AS rule, {says} AS verdict, bound FROM urls JOIN h USING (host)
"""


ORACLE = _oracle()
