"""URL rules, and verdicts of hosts by trust and distrust that flow along links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecclimb.session import Workspace

#: (verdict, host, path): a rule fits its host and all subdomains, on paths that start with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Trust and distrust that differ by no more than this part are even; ranks are settled more finely.
EVEN = 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, as host and path; its verdict), or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest decides last
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): how many links lead from the pages of a host to a host.

    pages has the column host. A link is an href in double or single quotes; one with :// or // in
    front names its host, one with another scheme is none, any other stays on its page's host.
    """
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'<>]*)["']"""), F.lit(1))
    # counted by page before the shuffle
    link = F.col("link")
    target = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(link)).when(link.startswith("//"), host_of(F.concat(F.lit("http:"), link))).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("host"))
    return pages.select("host", F.explode(links).alias("link")).select(F.col("host").alias("src"), target.alias("dst")).filter("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, work: Workspace, name: str, damping: float = 0.85, rounds: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """(host, rank) of every host that the seeds reach: random walks that restart at the seeds (host, weight), along edges (src, dst, n).

    The walk's share on hosts without links returns to the seeds, which only scales the visits of walks that
    end there; so visits are summed and scaled in the end. Links of a host to itself are summed in closed form.
    A round is two joins and an aggregate over hosts and edges; its table in the shared folder cuts the
    lineage. It ends when no host is new and each rank moves by less than tolerance, as a part of itself: from
    then on no rank ever moves by more than that in a round. RuntimeError if `rounds` do not suffice. Without
    seeds all ranks are missing.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    shares = edges.join(out, "src").select("src", "dst", (damping * F.col("n") / F.col("out")).alias("share"))
    stays = shares.filter("src = dst").select(F.col("dst").alias("host"), (1 / (1 - F.col("share"))).alias("visits"))
    visits = F.coalesce("visits", F.lit(1.0))
    start = work.save(seeds.join(stays, "host", "left").select("host", (F.col("weight") / F.lit(float(total or 1)) * visits).alias("restart")), f"{name}-seeds")
    steps = work.save(shares.filter("src <> dst").withColumnRenamed("dst", "host").join(stays, "host", "left").select("src", F.col("host").alias("dst"), (F.col("share") * visits).alias("share")), f"{name}-shares")
    ranks = start.select("host", F.col("restart").alias("rank"))
    change = F.when(F.col("old").isNull(), 1.0).when(F.col("rank") > 0, F.abs(F.col("rank") - F.col("old")) / F.col("rank")).otherwise(0.0)
    for i in range(rounds):
        flow = steps.join(ranks, steps.src == ranks.host).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = flow.join(start, flow.dst == start.host, "full").select(F.coalesce("dst", "host").alias("host"), (F.coalesce("flow", F.lit(0.0)) + F.coalesce("restart", F.lit(0.0))).alias("rank"))
        saved = work.save(new.join(ranks.withColumnRenamed("rank", "old"), "host", "left"), f"{name}-{i}")
        moved, scale = saved.agg(F.max(change), F.sum("rank")).first()
        if i:
            work.drop(f"{name}-{i - 1}")
        ranks = saved.select("host", "rank")
        if moved is None or moved < tolerance:
            return ranks.select("host", (F.col("rank") / F.lit(scale or 1.0)).alias("rank"))
    raise RuntimeError("ranks did not settle")


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    A page that a rule fits has the verdict of the longest. For the others the host decides: pages that
    rules allow or block make their hosts seeds of trust or of distrust, by number. Trust is the
    personalised PageRank from trusted hosts along the links, distrust that from blocked hosts against
    them. A host is blocked if distrust is more than `threshold` of the two together, by more than EVEN of
    it; a host that only distrust reaches is blocked however far it is, one that neither reaches is allowed.

    Null urls and urls without :// have an empty host and path, fit no rule and are allowed; null
    html has no links. Repeated rows are judged each, null ids are passed on, further columns are
    ignored, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"rule": rule, "by_rule": verdict})
    edges = work.save(host_edges(base), "edges")
    seeds = work.save(judged.filter("by_rule is not null and host <> ''").groupBy("host", "by_rule").agg(F.count("*").cast("double").alias("weight")), "seeds")
    trust = personalised_rank(edges, seeds.filter("by_rule = 'allow'").select("host", "weight"), work, "trust")
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(reverse, seeds.filter("by_rule = 'block'").select("host", "weight"), work, "distrust")
    hosts = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    more = F.when(F.col("trust").isNull(), F.lit(threshold < 1)).otherwise(F.col("distrust") > (1 + EVEN) * threshold * (F.col("trust") + F.col("distrust")))
    blocked = work.save(hosts.filter(F.col("distrust").isNotNull() & more).select("host", F.lit("block").alias("by_host")), "blocked")
    return judged.drop("html").join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
