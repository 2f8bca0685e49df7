"""URL filters: explicit rules, and link-graph propagation for the urls that no rule fits.

Hosts are the nodes; absolute links in the pages' HTML (``href`` and ``src``, with or without a
scheme) are weighted edges, links within a host are none.  A host is a trusted seed by the share of
its pages that rules allow, and a blocked seed by the share that rules block.  Personalised PageRank
carries trust along the edges; on the reversed edges it carries distrust to the hosts that link to
blocked ones.  A host is blocked when its distrust exceeds its trust by ``threshold`` of what a fully
blocked seed has from itself.

Everything is aggregated to hosts and host pairs before the first iteration (partial aggregates, so a
host with most of the pages costs a row per task), the iterations are joins and grouped sums over
those tables, and lineage is cut by checkpoints.

Defined results: a null url or one without ``://`` has an empty host and path, takes no part in the
graph, fits no rule and is allowed; null HTML has no links; a host without seeds or links is allowed;
repeated rows are judged each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

DAMPING = 0.85
#: Rounds end when no rank moves by more than ``TOLERANCE``, so what is left unspread is far below ``THRESHOLD``.
ITERATIONS = 60
TOLERANCE = 1e-4
THRESHOLD = 0.5

_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path prefix) that fits: struct of rule and verdict, null if none.

    A host's suffixes are looked up in a map from rule hosts, so the work follows the labels of a host
    and the rules of its domains, not the number of rules."""
    by_host: dict[str, list] = {}
    for verdict, rule_host, prefix in rules:
        by_host.setdefault(rule_host, []).append((prefix, rule_host + prefix, verdict))
    if not by_host:
        return F.lit(None).cast("struct<n: int, rule: string, verdict: string>")
    table = F.map_from_entries(F.array(*[
        F.struct(F.lit(h), F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
                                     for p, r, v in of]))
        for h, of in by_host.items()]))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(suffixes, lambda s: F.map_contains_key(table, s))
    fits = F.filter(F.flatten(F.transform(known, lambda s: F.element_at(table, s))), lambda x: F.startswith(path, x["prefix"]))
    return F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["rule"]).alias("n"), x["rule"].alias("rule"),
                                                            x["verdict"].alias("verdict"))))


def edges(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """``src``, ``dst``, ``w``: links between different hosts."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))
    links = pages.select(F.col(host_col).alias("src"), F.explode(found).alias("dst")).withColumn("dst", lower_ascii(F.col("dst")))
    return links.filter("src != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS,
              tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: ``host``, ``rank`` from ``seeds`` (host, seed) along ``links`` (src, dst, w).

    Ranks are scaled so that a seed of 1 without links in has rank 1."""
    out_weight = links.groupBy("src").agg(F.sum("w").alias("total"))
    shares = cut_lineage(links.join(out_weight, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    seeds = cut_lineage(seeds)
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    for i in range(iterations):
        sent = (shares.join(ranks.filter("rank > 0"), F.col("src") == F.col("host"))
                      .groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got")))
        new = seeds.join(sent, F.col("host") == F.col("to"), "left").select(
            "host", (F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = cut_lineage(new)
        moved = (new.join(ranks.withColumnRenamed("rank", "old"), "host")
                    .agg(F.max(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"])
        ranks = new
        if not moved or moved < tolerance:
            break
    return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING,
          iterations: int = ITERATIONS) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), and the host's ``trust`` and ``distrust``."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.col(f"`{html_col}`").alias("html"))
    # the rule is read several times: computed once, on the narrow copy that all later steps use
    ruled = cut_lineage(rows.drop("html").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)))
    links = cut_lineage(edges(rows, "host", "html"))

    verdict = F.col("fit.verdict")
    seen = ruled.filter("host != ''").groupBy("host").agg(
        F.avg(F.coalesce(verdict == "allow", F.lit(False)).cast("double")).alias("allowed"),
        F.avg(F.coalesce(verdict == "block", F.lit(False)).cast("double")).alias("blocked"))
    # a host known from links alone goes by the rule for its root
    linked = (links.select(F.col("dst").alias("host")).distinct().join(seen, "host", "left_anti")
                   .withColumn("v", fitting_rule(F.col("host"), F.lit("/"), rules)["verdict"])
                   .select("host", F.coalesce(F.col("v") == "allow", F.lit(False)).cast("double").alias("allowed"),
                           F.coalesce(F.col("v") == "block", F.lit(False)).cast("double").alias("blocked")))
    hosts = cut_lineage(seen.unionByName(linked))
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), links, damping, iterations)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), back, damping, iterations)
    scores = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host")
    out = ruled.join(scores, "host", "left")
    bad = F.coalesce(F.col("distrust") - F.col("trust") >= threshold, F.lit(False))
    return out.select("id", "host", "path", "fit.rule", F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
