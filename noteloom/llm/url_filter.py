"""URL filter: rules by host and path, and trust that is propagated over links between hosts.

A rule fits a host and its subdomains if the path starts with the rule's; the longest rule decides. Pages that no rule
fits are judged by their host. Hosts whose pages the rules mostly allow are trusted seeds, hosts whose pages
they mostly block are blocked seeds. Two personalised PageRanks run side by side: trust spreads from the
trusted seeds along links, distrust from the blocked seeds against them (who links to bad hosts is doubtful).
A host is blocked if its share of distrust is too large.

Only DataFrame functions are used. Links are taken from ``href``, ``src`` and ``action`` attributes, with a scheme or starting with
``//``, and counted once per page and target host; links inside a host do not count. The edge table is aggregated
before it is used and split by counted degrees, so that a host with very many links is dealt to several tasks. Mass is
kept in whole units: each flow is rounded on its own, and sums of whole numbers do not depend on their order.
Mass of hosts without links leaves the system; giving it back to the seeds would scale all ranks
by the same factor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import BROADCAST_BYTES, small, staged
from noteloom.runtime import BROADCAST_ROWS, lookup_join

UNITS = 10**15  # mass of all trusted seeds, and of all blocked ones
DAMPING = 0.85
ROUNDS = 20
DISTRUST_SHARE = 0.5
LINKS_PER_TASK = 200_000  # a host's links beyond this are split
_LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    """Allow or block a host, its subdomains, and the paths that start with ``path``."""

    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _small_letters(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, and from there up to ``?``, ``#`` or the end.

    Without ``://``, or for null, both are empty.
    """
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.split_part(F.split_part(rest, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    host = F.split_part(rest, F.lit("/"), F.lit(1))
    path = F.substr(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(_small_letters(host), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """(rule, allow) of the longest rule that fits, null if none does; of equally long ones the first in ``rules``."""
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((F.col(host) == rule.host) | F.endswith(F.col(host), F.lit("." + rule.host))) & F.startswith(F.col(path), F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allow"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): on how many of the rows of ``pages`` (host, html) a host links to another one."""
    found = F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))
    hosts = F.transform(found, lambda link: url_parts(F.when(F.startswith(link, F.lit("//")), F.concat(F.lit(":"), link)).otherwise(link))[0])
    targets = F.array_distinct(F.filter(hosts, lambda h: h != ""))
    linked = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return linked.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(
    links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, links_per_task: int = LINKS_PER_TASK
) -> DataFrame:
    """(kind, host, mass): personalised PageRank of the ``seeds`` (kind, host, mass) over ``links`` (kind, src, dst, n).

    Kinds are independent graphs. A host passes ``damping`` of its mass on, in shares by ``n``; a flow is rounded to
    whole units. Hosts without mass are not returned.
    """
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.count("*").alias("degree"))
    out = staged(out.withColumn("fan", F.ceil(F.col("degree") / links_per_task).cast("int")))
    hubs = small(staged(out.where("fan > 1").select("kind", "src", "fan")), 300)  # few: each has links_per_task links at least
    salt = F.pmod(F.xxhash64("dst"), F.coalesce("fan", F.lit(1))).cast("int").alias("salt")
    edges = staged(links.join(hubs, ["kind", "src"], "left").select("kind", "src", salt, "dst", "n"))
    seeds = staged(seeds)
    start = seeds.select("kind", "host", F.round(F.col("mass") * F.lit(1 - damping)).cast("long").alias("mass"))
    if edges.isEmpty():
        return start
    start = staged(start)
    ranks = start
    for _ in range(rounds):
        sent = ranks.withColumnRenamed("host", "src").join(out, ["kind", "src"])
        sent = sent.select("kind", "src", (F.col("mass") * F.lit(damping) / F.col("total")).alias("each"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
        flow = edges.join(sent, ["kind", "src", "salt"])
        flow = flow.select("kind", F.col("dst").alias("host"), F.round(F.col("each") * F.col("n")).cast("long").alias("mass"))
        ranks = staged(start.unionByName(flow).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0"))
    return ranks


def judge_hosts(pages: DataFrame, rounds: int = ROUNDS, share: float = DISTRUST_SHARE, units: int = UNITS) -> DataFrame:
    """(host, n_pages, trust, distrust, blocked) of every host of ``pages`` (host, html, allow).

    ``allow`` is a page's verdict by rule, null without one. A host is a trusted seed if more of its pages are allowed
    than blocked, a blocked seed if fewer are; each kind shares ``units`` evenly. It is blocked if its distrust is above
    0 and at least ``share`` of its trust and distrust together.
    """
    votes = F.sum(F.when(F.col("allow"), 1).when(~F.col("allow"), -1).otherwise(0))
    hosts = staged(pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n_pages"), votes.alias("votes")))
    n_good, n_bad = hosts.agg(F.count_if(F.col("votes") > 0), F.count_if(F.col("votes") < 0)).first()
    mass = F.round(F.lit(float(units)) / F.when(F.col("votes") > 0, max(n_good, 1)).otherwise(max(n_bad, 1))).cast("long")
    seeds = hosts.where("votes <> 0").select(F.when(F.col("votes") > 0, "trust").otherwise("distrust").alias("kind"), "host", mass.alias("mass"))
    links = staged(host_links(pages))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    ranks = propagate(both, seeds, rounds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).alias(kind)
    scores = ranks.groupBy("host").agg(of("trust"), of("distrust"))
    judged = hosts.select("host", "n_pages").join(scores, "host", "left").na.fill(0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= F.lit(share) * (F.col("trust") + F.col("distrust")))
    return judged.withColumn("blocked", bad)


def filter_urls(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS, share: float = DISTRUST_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages`` (page_id, url, html).

    The verdict is the longest fitting rule's, else that of the host by :func:`judge_hosts`. A null url, or one without
    ``://``, has an empty host and path; an empty host is no part of the graph, has no trust and is allowed unless a rule says otherwise. A
    null html has no links. Rows that repeat are judged alike and count as pages of their own. An empty table gives an
    empty result; other columns are ignored.
    """
    host, path = url_parts("url")
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = cut.withColumn("_fit", fitting_rule(rules)).select("page_id", "host", "path", "html", F.col("_fit.rule").alias("rule"), F.col("_fit.allow").alias("allow"))
    hosts = staged(judge_hosts(ruled.select("host", "html", "allow"), rounds, share))
    # only hosts with mass differ from the default, and the most frequent ones are joined by broadcast
    known = staged(hosts.where("trust > 0 or distrust > 0"))
    size = known.agg(F.sum(F.octet_length("host") + 48)).first()[0] or 0
    rows = BROADCAST_ROWS if size <= BROADCAST_BYTES else BROADCAST_ROWS + 1  # the bound is one of bytes here
    judged = lookup_join(ruled.drop("html"), known, ["host"], weight="n_pages", how="left", dim_rows=rows)
    allow = F.coalesce("allow", ~F.col("blocked"), F.lit(True))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(allow, "allow").otherwise("block").alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"),
        F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )
