"""URL verdicts: path rules first, then trust and distrust spread over the link graph of hosts.

Pages give host-to-host edges, weighted by their links. Trust starts at hosts with pages that an allow
rule takes and flows along links (personalised PageRank). Distrust starts at hosts with pages that a
block rule takes and flows against links: who links to bad hosts is suspect. Seeds weigh as many as
their pages. A host is blocked if its distrust is over `threshold` times its trust; a host that
neither reaches is allowed. Both are carried on until they are settled, however long the paths are.

All of it is DataFrame code: edges and seeds are aggregated by key before they are joined, and a host's
pages meet its verdict in a join that AQE can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, THRESHOLD = 0.85, 1.0
#: Ranks are settled once no round adds more than this share to any of them.
TOLERANCE = 1e-10
#: The share by which settled ranks may differ from exact ones; ranks this close are equal.
SLACK = 1e-9


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))


def with_host(df: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null url or one without '://'."""
    rest = _rest(F.col("url"))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. rules is a
    configured list; among rules of one length the first in order of text wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from the href values of pages (host, html). A link without a host stays on
    its page's host. Pages without a host give no edge."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)(?<![\w-])href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))).alias("href"))
    outer = F.regexp_extract("href", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1)
    inner = ~F.col("href").rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)")
    dst = F.when(outer != "", F.translate(outer, UPPER, LOWER)).when(inner, F.col("host"))
    return links.select(F.col("host").alias("src"), dst.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of several kinds at once: (kind, host, rank) from edges (kind, src, dst,
    weight) and seeds (kind, host, mass, which sum to 1 a kind). What a host without links holds goes
    back to the seeds; damping is below 1.

    The rank is in proportion to the sum over all paths from the seeds. A round adds the paths of one
    more link; links of a host to itself are summed in closed form. The rounds end when none adds more
    than `tolerance` of itself to any rank, so never while hosts are still being reached. A round is
    one job, whose result is written, and one look at it.
    """
    out = edges.groupBy("kind", F.col("src").alias("host")).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("own"))
    left = F.col("total") - F.col("own") * damping
    away = edges.where("src <> dst").withColumnRenamed("src", "host")
    steps = materialize(away.join(out, ["kind", "host"]).select("kind", "host", "dst", (F.col("weight") * damping / left).alias("share")), "steps")
    kept = materialize(seeds.select("kind", "host", F.col("mass").alias("sum"), F.col("mass").alias("fresh")), "rank")
    while not kept.where(F.col("fresh") > F.col("sum") * tolerance).isEmpty():
        moved = kept.where("fresh > 0").join(steps, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("fresh") * F.col("share")).alias("got"))
        got = F.coalesce("got", F.lit(0.0))
        rank = materialize(kept.drop("fresh").join(moved, ["kind", "host"], "full").select("kind", "host", (F.coalesce("sum", F.lit(0.0)) + got).alias("sum"), got.alias("fresh")), "rank")
        drop_table(kept)
        kept = rank
    whole = kept.join(out, ["kind", "host"], "left").select("kind", "host", (F.col("sum") * F.coalesce(F.col("total") / left, F.lit(1.0))).alias("rank"))
    every = whole.groupBy("kind").agg(F.sum("rank").alias("every"))
    return whole.join(F.broadcast(every), "kind").select("kind", "host", (F.col("rank") / F.col("every")).alias("rank"))  # a row a kind


def seed_mass(pages: DataFrame) -> DataFrame:
    """(kind, host, mass): the share of each host in the pages that an allow rule (kind 'trust') or a
    block rule (kind 'distrust') takes."""
    kind = F.when(F.col("judged.verdict") == "allow", "trust").when(F.col("judged.verdict") == "block", "distrust")
    counts = pages.where("host <> ''").select(kind.alias("kind"), "host").where("kind is not null").groupBy("kind", "host").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass"))  # a row a kind


def host_verdicts(pages: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, host_verdict) from pages (host, html, judged)."""
    edges = materialize(host_edges(pages), "edges")
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    ranks = spread(ways, seed_mass(pages.select("host", "judged")), damping, tolerance)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    both = ranks.groupBy("host").agg(of("trust"), of("distrust"))
    return both.withColumn("host_verdict", F.when(F.col("distrust") > F.col("trust") * threshold * (1 + SLACK), "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: list[Rule], damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, host, path, rule, verdict, trust, distrust), a row for
    each row.

    rule is null where none fits; the verdict is then the host's. Null urls and those without '://'
    have an empty host and path and are allowed; null html has no links. Repeated pages count each
    time. An empty table gives an empty result; further columns are ignored.
    """
    small = with_host(pages.select("page_id", "url", "html"))
    small = small.withColumn("judged", rule_of(F.col("host"), F.col("path"), rules))
    hosts = materialize(host_verdicts(small.select("host", "html", "judged"), damping, tolerance, threshold), "hosts")
    out = small.select("page_id", "host", "path", "judged").join(hosts, "host", "left")
    return out.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), F.coalesce("judged.verdict", "host_verdict", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
