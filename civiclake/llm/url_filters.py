"""URL filters: rules by host and path, and for all other pages a verdict per host from trust and distrust on the host graph.

Hosts are linked by the absolute addresses in their pages' markup (relative ones stay on their host) and, more weakly, with their parent
domains, the less the more children a parent has. Trust is personalised PageRank from the hosts of allowed pages along the links; distrust is
the same from the hosts of blocked pages against them, since who links to bad hosts is suspect. Seeds weigh as their share of
pages. A third walk, against the links from all hosts alike, says how much of any walk a host gets by its place alone: a portal that
links to everything has some distrust and much of that. A host is blocked where distrust is more than ``mass`` times this
share and makes up more than ``threshold`` of trust and distrust; a host that neither reaches is allowed.

All walks are one table of ranks and one of edges, so an iteration is one join and one aggregation; links are counted per
pair of hosts before anything is joined, so a host with very many pages is one row. Ranks are written every few iterations.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null markup has no links; of
equally long rules the first fits; repeated rows are judged each; without rules everything is allowed.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute or scheme-relative address in an attribute.
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # without the leading slash

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[Rule], result) -> Column:
    """``result(rule)`` of the longest rule that fits, as one conditional; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith("/" + rule.path)
        out = F.when(fits, F.lit(result(rule))).otherwise(out)
    return out


def link_edges(pages: DataFrame, host: str, markup: str) -> DataFrame:
    """``src, dst, weight``: on how many pages of a host another host is linked."""
    found = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.col(markup), F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    found = found.where("src <> '' and dst <> src")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def family_edges(hosts: DataFrame, weight: float) -> DataFrame:
    """Edges both ways between each host and its parent domains of two labels or more, the weight shared by a parent's children."""
    up = hosts.select(F.col("host").alias("child"), F.split("host", r"\.").alias("labels")).where(F.size("labels") > 2)
    chain = up.select(F.explode(F.expr(
        "transform(sequence(1, size(labels) - 2), i -> struct(array_join(slice(labels, i, size(labels)), '.') as a, "
        "array_join(slice(labels, i + 1, size(labels)), '.') as b))")).alias("e")).select("e.a", "e.b").distinct()
    children = chain.groupBy("b").agg(F.count(F.lit(1)).alias("children"))
    chain = chain.join(children, "b")
    w = F.lit(weight) / F.col("children")
    return chain.select(F.col("a").alias("src"), F.col("b").alias("dst"), w.alias("weight")).unionByName(
        chain.select(F.col("b").alias("src"), F.col("a").alias("dst"), w.alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, iterations: int = 64, tolerance: float = 1e-3,
              every: int = 8) -> DataFrame:
    """``kind, host, rank`` of personalised PageRank over ``kind, src, dst, weight`` from ``kind, host, seed`` (summing to 1 a kind).

    What reaches hosts without outgoing edges would return to the seeds, which only scales all ranks: so ranks are summed up
    without it and scaled to 1 a kind at the end. Edges of a host that weigh under 1 together carry that part of its rank, the rest returns
    too. A walk not settled after ``iterations`` gives a warning.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    steps = edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.greatest("all", F.lit(1.0)) * damping).alias("share"))
    steps, seeds = materialise(steps, "steps"), materialise(seeds, "seeds")
    ranks = seeds.withColumnRenamed("seed", "rank")
    for done in range(every, iterations + every, every):
        new = ranks
        for _ in range(every):
            moved = new.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            new = moved.unionByName(seeds.withColumnRenamed("seed", "rank")).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        new = materialise(new, "ranks")
        change = new.groupBy().agg(F.sum("rank")).first()[0] or 0.0
        before = ranks.groupBy().agg(F.sum("rank")).first()[0] or 0.0
        ranks = new
        if change - before <= tolerance * change:  # ranks only grow, so their sum tells how far they are from settled
            break
    else:
        warnings.warn(f"host ranks still grow by {(change - before) / max(change, 1e-300):.2g} of themselves after {iterations} steps", stacklevel=2)
    total = ranks.groupBy("kind").agg(F.sum("rank").alias("all"))
    return ranks.join(total, "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))


def host_verdicts(judged: DataFrame, edges: DataFrame, *, threshold: float = 0.5, mass: float = 1.0, **options) -> DataFrame:
    """``host, trust, distrust, expected, verdict`` from pages with ``host`` and ``ruled`` (allow, block or null) and link edges."""
    counts = judged.where("host <> '' and ruled is not null").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    everyone = judged.where("host <> ''").select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(
        edges.select(F.col("dst").alias("host"))).distinct().select(F.lit("any").alias("kind"), "host", F.lit(1).cast("long").alias("n"))
    counts = counts.unionByName(everyone)
    totals = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = counts.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed"))
    against = edges.select(F.explode(F.array(F.lit("block"), F.lit("any"))).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    walks = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(against)
    ranks = propagate(walks, seeds, **options)

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))

    per_host = ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"), of("any").alias("expected"))
    bad = (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") > mass * F.col("expected"))
    return per_host.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url: str = "url", markup: str = "html",
                family_weight: float = 0.5, threshold: float = 0.5, mass: float = 1.0, **options) -> DataFrame:
    """``_id, _host, _path, _rule, _verdict, _trust, _distrust`` for each page."""
    parts = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(markup).alias("markup"))
    judged = parts.select("*", first_rule(F.col("host"), F.col("path"), rules, lambda r: r.text).alias("rule"),
                          first_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict).alias("ruled"))
    links = materialise(link_edges(parts, "host", "markup"), "links")
    hosts = judged.where("host <> ''").select("host").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    edges = links.unionByName(family_edges(hosts, family_weight)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    verdicts = materialise(host_verdicts(judged, edges, threshold=threshold, mass=mass, **options), "verdicts")
    named = verdicts.select(F.col("host").alias("_of"), "trust", "distrust", "verdict")
    out = judged.select("_id", "host", "path", "rule", "ruled").join(named, F.col("host") == F.col("_of"), "left")
    return out.select("_id", F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("rule").alias("_rule"),
                      F.coalesce("ruled", "verdict", F.lit("allow")).alias("_verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("_trust"), F.coalesce("distrust", F.lit(0.0)).alias("_distrust"))
