"""Host reputation: labelled outcomes of pages, shrunk from host to registered domain to suffix by beta-binomial priors.

The share of bad pages of a suffix is drawn to the share of all, that of a registered domain to its suffix's, that of
a host to its domain's. How strongly is learned from the data at each level, by moments: what the children's counts
vary more than chance gives the correlation rho of outcomes under one parent, and a prior of ``1 / rho - 1`` pages. A
host is blocked if the lower bound of its posterior, ``DEVIATIONS`` standard deviations below the mean, exceeds
``BLOCK``: a host with few labelled pages is only blocked if its domain is bad. Rules come first, the longest that fits.

Everything is DataFrame functions. Counts are aggregated for each host before anything is joined; pages meet labels by
page id, and hosts that are blocked by host. The driver holds three prior sizes and the share of all.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits; empty hosts have no
reputation and are allowed. Ports and a last dot do not count for the reputation, but do for the rules, which compare the
host as it stands. Hosts of digits and dots (addresses) are domains of their own under no suffix. Several label rows of
a page are one outcome, bad if any says so; label rows with both values null say nothing. Without labels all hosts that
no rule judges are allowed. Repeated pages keep their rows. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import cut

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# Second-level labels below which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
BLOCK, DEVIATIONS = 0.5, 1.645
RHO_LEAST, RHO_MOST, RHO_UNKNOWN = 1e-4, 0.95, 0.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Lower-cased host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.translate(F.regexp_extract(behind(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(behind(url), "^[^/?#]*([^?#]*)", 1)


def behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits; of equally long ones the first; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without port."""
    parts = F.split(host, "[.]")
    n = F.size(parts)
    address = host.rlike("^[0-9.]+$")
    two = (n > 2) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.lit(1), n - k + 1), F.lit(8)), ".")
    domain = F.when(address | (n < 2), host).when(two, last(3)).otherwise(last(2))
    return domain, F.when(address, "").when(two, last(2)).otherwise(last(1))


def outcomes(labels: DataFrame) -> DataFrame:
    """``id, bad``: pages of low quality or toxic text are bad, pages with a label and neither are good."""
    bad = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0), F.when(F.col("toxic") == 1, 1).when(F.col("toxic").isNotNull(), 0))
    return labels.select(F.col("doc_id").alias("id"), bad.alias("bad")).where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))


def prior_size(children: DataFrame) -> float:
    """Pages that the prior of a level counts as; ``children``: ``y`` bad of ``n``, and the mean ``m`` of the parent."""
    chance = F.col("m") * (1 - F.col("m"))
    over = F.sum(F.pow(F.col("y") - F.col("n") * F.col("m"), F.lit(2)) - F.col("n") * chance)
    row = children.where("n > 0").agg((over / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * chance), F.lit(0.0))).alias("rho")).first()
    rho = RHO_UNKNOWN if row.rho is None else min(max(row.rho, RHO_LEAST), RHO_MOST)
    return 1 / rho - 1


def shrunk(children: DataFrame) -> DataFrame:
    """Adds the prior size ``k`` of the level."""
    return children.withColumn("k", F.lit(prior_size(children)))


def reputation(pages: DataFrame, outcome: DataFrame) -> DataFrame:
    """``name, domain, suffix, n, y, mean, bound`` of every host; ``pages``: ``page_id, host``; ``outcome``: ``id, bad``."""
    name = F.regexp_replace(F.regexp_replace("host", ":[0-9]*$", ""), "[.]$", "")
    seen = pages.join(outcome, F.col("page_id") == F.col("id"), "left").select(name.alias("name"), "bad").where("name <> ''")
    domain, suffix = levels(F.col("name"))
    hosts = cut(seen.groupBy("name").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y")).select("name", domain.alias("domain"), suffix.alias("suffix"), "n", "y"))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    mean = (F.col("y") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k"))
    suffixes = cut(shrunk(suffixes.withColumn("m", F.lit((total.y + 1) / (total.n + 2)))).select(F.col("suffix").alias("_s"), mean.alias("m")))
    domains = domains.join(suffixes, F.col("suffix") == F.col("_s")).drop("_s")
    domains = cut(shrunk(domains).select(F.col("domain").alias("_d"), F.col("suffix").alias("_s"), mean.alias("m")))
    hosts = cut(hosts.join(domains, (F.col("domain") == F.col("_d")) & (F.col("suffix") == F.col("_s"))).drop("_d", "_s"))
    a, b = F.col("y") + F.col("k") * F.col("m"), F.col("n") - F.col("y") + F.col("k") * (1 - F.col("m"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return shrunk(hosts).select("name", "domain", "suffix", "n", "y", (a / (a + b)).alias("mean"), (a / (a + b) - DEVIATIONS * deviation).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``page_id, url``.

    ``labels`` (``doc_id, quality, toxic``) hold the outcome of the page with that id.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = reputation(rows.select("page_id", "host"), outcomes(labels)).where(F.col("bound") > BLOCK)
    # Only blocked names are joined, from a written table of known size; a hot host's pages are split where skewed.
    bad = cut(bad.select(F.col("name").alias("_name")))
    name = F.regexp_replace(F.regexp_replace("host", ":[0-9]*$", ""), "[.]$", "")
    out = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).join(bad, name == F.col("_name"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_name").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
