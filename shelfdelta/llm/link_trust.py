"""URL filter: trust and distrust spread over the host graph.

Allow and block rules (host, path prefix) judge URLs directly. The share of a host's pages
that the rules allow (block) seeds trust (distrust). Trust follows links from a host to what
it links to, as personalised PageRank; distrust goes the other way, from a host to those that
link to it, both until no host's score is further than ``tolerance`` from the limit. A host is
blocked where its margin exceeds ``threshold``: distrust less trust, as a share of trust,
distrust and what its pages without a rule would seed. The margin lies between -1 and 1 whatever
``damping`` is; without edges it is the share of blocked pages less that of allowed ones.

Edges: absolute and protocol-relative ``href``/``src`` links between hosts, counted, and
between a host and its parent host where both are in the table (``www.a.b`` and ``a.b``).

Defined results: a null url, or one without ``://``, has an empty host and path, matches no
rule and is allowed; of rules of equal length that fit, block wins, then the text order;
repeated rows are judged alike; null html has no links; an empty table gives an empty one.
Column expressions, joins and aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.llm.common import staged

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, block, rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(int(v == "block")).alias("block"), F.lit(h + p).alias("rule"),
                            F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def edges_of(pages: DataFrame) -> DataFrame:
    """(source, target, weight) over hosts: links, then parent hosts both ways."""
    hosts = pages.where("host <> ''").select("host").distinct()
    found = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.array_distinct(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1))).alias("raw"))
    links = found.select("source", F.translate("raw", _UPPER, _LOWER).alias("target")).where(
        "source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    child = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("parent"))
    kin = child.join(hosts.select(F.col("host").alias("parent")), "parent").select("host", "parent")
    one = F.lit(1.0).alias("weight")
    return links.unionByName(kin.select(F.col("host").alias("source"), F.col("parent").alias("target"), one)).unionByName(
        kin.select(F.col("parent").alias("source"), F.col("host").alias("target"), one)).groupBy("source", "target").agg(
        F.sum("weight").alias("weight"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, cut_every: int = 4) -> DataFrame:
    """(kind, host, score) of ``score = (1 - damping) seed + damping inflow``, each within ``tolerance`` of the limit.

    Scores only grow, and what ``cut_every`` rounds add falls by ``damping ** cut_every`` at least, which
    bounds all that is still to come.
    """
    if not 0 <= damping < 1:
        raise ValueError("scores have a limit for a damping from 0 to below 1")
    both = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), "target", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("target"), "weight"))
    total = both.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    steps = staged(both.join(total, ["kind", "host"]).select("kind", "host", "target", (F.col("weight") / F.col("total")).alias("share")), "host-edges")
    seeds = staged(seeds, "host-seeds")
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    mass = lambda df: df.agg(F.sum("score")).first()[0] or 0.0
    scores, now, falls = base, mass(base), damping ** cut_every
    while True:
        for _ in range(cut_every):
            flow = scores.join(steps, ["kind", "host"]).select("kind", F.col("target").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            scores = base.unionByName(flow).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores = staged(scores, "host-scores")
        before, now = now, mass(scores)
        if (now - before) * falls <= tolerance * (1 - falls):
            return scores


def judge(pages: DataFrame, *, rules=RULES, damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 0.25,
          id_col: str = "page_id") -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the host's trust and distrust."""
    based = pages.select(F.col(id_col).alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = based.select(id_col, "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("best"))
    per_host = ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("best.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("best.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    seeds = per_host.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias(
        "kind", "seed")).where("seed > 0")
    scores = spread(seeds, edges_of(based), damping, tolerance)
    by_host = scores.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"))
    unruled = per_host.select("host", ((1 - F.col("trust") - F.col("distrust")) * (1 - damping)).alias("unruled"))
    margin = (F.col("distrust") - F.col("trust")) / (F.col("distrust") + F.col("trust") + F.col("unruled"))
    of_method = F.when(F.coalesce(margin, F.lit(0.0)) > threshold, "block").otherwise("allow")
    return ruled.join(by_host.join(unruled, "host"), "host", "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", of_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"))
