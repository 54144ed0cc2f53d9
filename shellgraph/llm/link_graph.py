"""URL filters: explicit rules, and trust and distrust propagated over the host graph.

Trust is personalised PageRank from trusted hosts along links; distrust is the same from blocked
hosts against the direction of links, since linking to bad hosts is what makes a host suspect.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count
from sys import float_info

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, a struct (rule, verdict), or null. A rule fits its host and all
    subdomains where the path starts with its path. Of equally long ones the longer host, then the
    first by text counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): absolute links between different hosts, counted. Relative links stay on
    their host and are left out, as are pages without host and empty targets."""
    links = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    out = out.select("src", host_of(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(scratch: C.Scratch, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds(host, mass)`` along ``edges(src, dst, weight)``.

    A host's rank goes to its links by weight; what a host without links holds returns to the
    seeds. Rounds end when no host is newly reached and no rank changes by more than ``tolerance`` of
    itself, however small it is, or after ``rounds`` if given. Sums over a hub's links combine before
    they shuffle. No seeds: no ranks. Seeds without any edge keep their mass.
    """
    seeds = seeds.groupBy("host").agg(F.sum("mass").alias("mass")).where("mass > 0")
    total = seeds.agg(F.sum("mass")).first()[0]
    seeds = scratch.save(seeds.select("host", (F.col("mass") / F.lit(total or 1.0)).alias("seed")), "seeds")
    if not total or edges.isEmpty():
        return seeds.select("host", F.col("seed").alias("rank"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = scratch.save(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "shares")
    rank = scratch.save(seeds.select("host", F.col("seed").alias("rank")), "rank")
    now, before = F.coalesce("now", F.lit(0.0)), F.coalesce("rank", F.lit(0.0))
    for _ in count() if rounds is None else range(rounds):
        given = shares.join(rank.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        arrived = given.agg(F.sum("given")).first()[0] or 0.0
        lost = 1.0 - damping * arrived  # jumps, and ranks of hosts without links
        new = given.join(seeds, "host", "full").select("host", (F.coalesce("given", F.lit(0.0)) * damping + F.coalesce("seed", F.lit(0.0)) * lost).alias("rank"))
        new = scratch.save(new, "rank")
        moving = new.withColumnRenamed("rank", "now").join(rank, "host", "full").where(F.abs(now - before) > now * tolerance + float_info.min)
        settled = moving.isEmpty()
        scratch.drop(rank)
        rank = new
        if settled:
            break
    return rank


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 1.0) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict, trust, distrust.

    The rule's verdict where one fits. Else the method's: block where the host's distrust exceeds
    ``threshold`` times its trust, allow otherwise (so hosts nothing is known of, and rows without
    host, are allowed). Seeds are the hosts of pages that a rule allows or blocks, weighed by those
    pages. Null html has no links; repeated rows count again.
    """
    scratch = C.Scratch(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules))
    seeds = rows.where("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("__best.verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("__best.verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    seeds = scratch.save(seeds, "seeds")
    edges = scratch.save(host_edges(pages.select(url.alias("url"), "html")), "edges")
    trust = propagate(scratch, edges, seeds.select("host", F.col("good").alias("mass")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(scratch, back, seeds.select("host", F.col("bad").alias("mass")))
    ranks = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    out = rows.join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), method).alias("verdict"), "trust", "distrust")
