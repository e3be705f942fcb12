"""URL filter: rules first, empirical-Bayes host reputation for the rest.

Pages that a rule judges are the labelled outcomes (blocked = bad).  Bad rates
are shrunk down the chain suffix -> registered domain -> host: each level's
prior is a beta distribution whose mean is its parent's posterior mean and
whose strength comes from a one-way analysis of variance between the groups of
that level (overdispersed groups get a weak prior).  A host is blocked when the
lower bound of its posterior bad rate, ``mean - z * sd``, lies above
``threshold``.  Hosts without a labelled page inherit their parents' posterior.

Everything is DataFrame code; host counts are aggregated map-side, so a host
with a third of all pages is one row per task, and the join that brings a
host's verdict back to its pages is a plain equi-join that Spark may split.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and gets the reputation of the empty host; repeated rows are pages
of their own; without any labelled page nothing is blocked but by rules; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, kept

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Z, THRESHOLD = 1.645, 0.5
#: bounds of a prior's strength (pseudo-pages)
WEAKEST, STRONGEST = 1.0, 1000.0

Rule = tuple[str, str, str]  # verdict, host, path


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longest outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) \
            .otherwise(out)
    return out


def strength(groups: DataFrame) -> float:
    """Prior strength from (n, bad) of one level's groups, by analysis of variance."""
    g = groups.where("n > 0")
    t = g.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
              F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
              F.sum(F.col("bad") * (F.lit(1.0) - F.col("bad") / F.col("n"))).alias("within"),
              F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("raw")).first()
    if t.g < 2 or t.n <= t.g:
        return WEAKEST
    between = (t.raw - t.bad * t.bad / t.n) / (t.g - 1)
    within = t.within / (t.n - t.g)
    n0 = (t.n - t.nn / t.n) / (t.g - 1)
    spread = between + (n0 - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    return STRONGEST if rho <= 0 else min(max((1 - rho) / rho, WEAKEST), STRONGEST)


def host_verdicts(pages: DataFrame, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """(host, label) rows -> host, n, bad, rate (posterior mean), bound, verdict.

    ``label`` is 1 for bad, 0 for good, null for a page without an outcome.
    """
    hosts = kept(pages.groupBy("host").agg(F.count("label").alias("n"),
                                           F.coalesce(F.sum("label"), F.lit(0)).alias("bad")),
                 "hosts")
    parts = F.split("host", r"\.")
    hosts = hosts.select("host", "n", "bad", F.element_at(parts, -1).alias("suffix"),
                         F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))
                         .alias("domain"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = (total.bad or 0) / total.n if total.n else 0.0
    ks, kd, kh = strength(suffixes), strength(domains), strength(hosts)

    def shrunk(prior, k: float) -> Column:
        return (F.col("bad") + F.lit(k) * prior) / (F.col("n") + F.lit(k))

    s = suffixes.select("suffix", shrunk(F.lit(base), ks).alias("s_rate"))
    d = domains.join(s, "suffix").select("suffix", "domain", shrunk(F.col("s_rate"), kd).alias("d_rate"))
    h = hosts.join(d, ["suffix", "domain"]).select("host", "n", "bad",
                                                   shrunk(F.col("d_rate"), kh).alias("rate"))
    sd = F.sqrt(F.col("rate") * (F.lit(1.0) - F.col("rate")) / (F.col("n") + F.lit(kh + 1.0)))
    h = h.withColumn("bound", F.col("rate") - F.lit(z) * sd)
    return h.withColumn("verdict", F.when(F.col("bound") > threshold, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id",
               url_col: str = "url", z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and its host's rate and bound."""
    host, path = host_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("_m", matching_rule(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("_m.verdict") == "block", 1).when(F.col("_m.verdict") == "allow", 0)
    hosts = host_verdicts(p.select("host", label.alias("label")), z, threshold)
    out = p.join(hosts.select("host", "rate", "bound", F.col("verdict").alias("_v")), "host", "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_m.rule").alias("rule"),
                      F.coalesce(F.col("_m.verdict"), F.col("_v")).alias("verdict"), "rate", "bound")
