"""URL filters: host and path rules, and trust that spreads over the links between hosts.

Hosts of allowed urls seed trust, which follows links (personalised PageRank); hosts of
blocked urls seed distrust, which goes against them: whoever links to a blocked host is less to be
trusted. A host is blocked where its distrust exceeds ``threshold`` times its trust.
A url that a rule fits has the rule's verdict, any other has its host's.

DataFrame operations only. Links are counted per pair of hosts before anything is
joined; the rank steps run over hosts, not pages, each stashed. The links of a hub, a host
that very many link to (distrust runs against links), are dealt to several tasks, and only its one rank is repeated for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, pieces_of, repeated, sized, stash, unstash

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of a link that names one, with its scheme or by ``//host``; any other link stays on its page's own host.
_LINK = r"""(?i)(?:href|src)\s*+=\s*+["']?(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s>]+)"""


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host (or a parent) and
    the path's start, else null. Of equally long rules the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, pages): pages of a host with an absolute link to another host."""
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)), _lower_ascii)))
    links = pages.select(host_of(F.col(url_col)).alias("src"), to.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 100, error: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from links (src, dst, pages) and seeds (host, trust, distrust). The seeds of either kind are
    shares of 1, however many pages were ruled, so trust and distrust can be compared.

    rank = (1 - damping) seed + damping * what comes over the edges, trust forwards and distrust
    backwards; a host without such edges hands its share to nobody. Stops when no
    host moves by more than ``error``; what still moves after n rounds is at most damping^n, so the rounds given always get there."""
    links = stash(links)
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "pages").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "pages"))
    key = ["kind", "host"]
    both = both.select("kind", F.col("a").alias("host"), "b", "pages")
    out_of = stash(both.groupBy(*key).agg(F.sum("pages").alias("all"), F.count(F.lit(1)).alias("copies")))
    hubs = stash(pieces_of(out_of, key))
    edges = stash(dealt(both, hubs, key, F.xxhash64("b")).join(repeated(out_of.drop("copies"), hubs, key), [*key, "_part"]).select(*key, "_part", "b", (F.col("pages") / F.col("all")).alias("share")))
    start = stash(seeds.select("host", F.expr("stack(2, 'trust', double(trust), 'distrust', double(distrust)) as (kind, seed)")).where("seed > 0"))
    whole = start.groupBy("kind").agg(F.sum("seed").alias("whole"))
    raw, start = start, stash(start.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("seed") / F.col("whole")).alias("seed")))
    rank = stash(start.select("kind", "host", F.col("seed").alias("rank"), F.lit(0.0).alias("off")))
    for _ in range(rounds):
        came = repeated(rank, hubs, key).join(edges, [*key, "_part"]).select("kind", F.col("b").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"), F.lit(0.0).alias("old"))
        base = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"), F.lit(0.0).alias("old"))
        was = rank.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        step = came.unionByName(base).unionByName(was).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"))
        new = stash(step.select("kind", "host", "rank", F.abs(F.col("rank") - F.col("old")).alias("off")))
        unstash(rank)
        rank = new
        if (rank.agg(F.max("off")).first()[0] or 0.0) <= error:
            break
    unstash(links, raw, edges, start, out_of, hubs)
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k)
    return rank.groupBy("host").agg(side("trust"), side("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict), one row per page.

    Null urls and urls without ``://`` have empty host and path, no rule, and are allowed: the method
    knows nothing of them, as of any host without trust or distrust. Repeated pages
    are judged alike and count as often as they occur; null html has no links."""
    own = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own = own.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    seeds = own.where("host <> ''").groupBy("host").agg(F.count_if(F.col("_r.verdict") == "allow").alias("trust"), F.count_if(F.col("_r.verdict") == "block").alias("distrust"))
    hosts = stash(spread(host_links(pages, url_col, html_col), seeds).select("host", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow").alias("_by_host")))
    out = own.join(sized(hosts), "host", "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "_by_host", F.lit("allow")).alias("verdict"))
