"""URL verdicts: host and path rules, else trust and distrust spread over the host graph.

Rules allow or block a host, its subdomains and the paths below a prefix; the
longest fitting rule wins. Urls that no rule fits take the verdict of their
host. A host's seed of trust (distrust) is the share of its pages that rules
allow (block). Trust flows along links by personalised PageRank; distrust flows
against them, from a blocked host to those that link to it. A host is blocked
if its distrust exceeds its trust by the threshold or more.

Defined results
    null url or one without ``://``: host and path empty, no rule, verdict
    allow; null html: no links; links to the own host: ignored; repeated rows:
    judged each; equally long rules: the first in text order; empty table: no
    rows; further columns: left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii

#: Rules up to this number are one expression; more are joined by host suffix.
INLINE_RULES = 500
#: A host table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _authority_and_path(url: Column) -> Column:
    """What follows the first ``://``, up to the first ? or #; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    return F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.substring_index(_authority_and_path(url), "/", 1))


def path_of(url: Column) -> Column:
    whole = _authority_and_path(url)
    return F.substr(whole, F.char_length(F.substring_index(whole, "/", 1)) + 1)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def match_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add rule and rule_verdict; pages has host and path."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    if len(ranked) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r in reversed(ranked):
            fit = _fits(r, F.col("host"), F.col("path"))
            rule = F.when(fit, F.lit(r.name)).otherwise(rule)
            verdict = F.when(fit, F.lit(r.verdict)).otherwise(verdict)
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = pages.sparkSession
    table = spark.createDataFrame(
        [(r.verdict, r.host, r.path, r.name) for r in ranked], "v string, rule_host string, rule_path string, name string"
    )
    # Rules are judged once for each distinct host and path, so a host with many pages costs no more than its paths.
    keys = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fit = keys.select("host", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host")
    fit = fit.filter(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy("host", "path").agg(
        F.min(F.struct((-F.char_length("name")).alias("l"), "name", "v")).alias("b")
    )
    best = best.select("host", "path", F.col("b.name").alias("rule"), F.col("b.v").alias("rule_verdict"))
    return pages.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, share: links between different hosts, each host's shares adding up to 1."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""), F.lit(1))
    links = (
        pages.filter(F.col("html").contains("//"))
        .select("host", F.explode(found).alias("to"))
        .select(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst"))
        .filter((F.col("src") != F.col("dst")) & (F.col("src") != ""))
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    """host, trust, distrust after the given rounds; seeds has the same columns."""
    edges = checkpointed(edges)
    if edges.isEmpty():
        return seeds
    into = edges.groupBy("dst").agg(F.sum("share").alias("all"))
    back = edges.join(into, "dst").select("src", "dst", "share", (F.col("share") / F.col("all")).alias("back"))
    back = checkpointed(back)
    state = seeds
    for k in range(rounds):
        t = back.join(state, back["src"] == state["host"]).select(
            back["dst"].alias("host"), (back["share"] * F.col("trust")).alias("t"), F.lit(0.0).alias("d")
        )
        d = back.join(state, back["dst"] == state["host"]).select(
            back["src"].alias("host"), F.lit(0.0).alias("t"), (back["back"] * F.col("distrust")).alias("d")
        )
        base = seeds.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        flow = [F.lit(damping) * F.col(c) for c in ("t", "d")]
        moved = t.unionByName(d).select("host", flow[0].alias("t"), flow[1].alias("d"))
        state = base.unionByName(moved).groupBy("host").agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))
        if k % 2 or k + 1 == rounds:
            state = checkpointed(state)
    return state


def judge_urls(
    pages: DataFrame, rules: list[Rule], threshold: float = 0.5, damping: float = 0.85, rounds: int = 10
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    parsed = match_rules(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html"), rules
    )
    rate = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    seeds = parsed.filter("host <> ''").groupBy("host").agg(
        rate("allow").alias("trust"), rate("block").alias("distrust")
    )
    ranks = propagate(checkpointed(seeds), host_edges(parsed), damping, rounds)
    ranks = ranks.select("host", "trust", "distrust")
    if ranks.count() <= BROADCAST_HOSTS:
        ranks = F.broadcast(ranks)
    out = parsed.drop("html").join(ranks, "host", "left")
    own = F.when(
        F.coalesce(F.col("distrust"), F.lit(0.0)) - F.coalesce(F.col("trust"), F.lit(0.0)) >= threshold, "block"
    ).otherwise("allow")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
