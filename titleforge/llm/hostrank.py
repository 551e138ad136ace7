"""URL filters (operator 7): trust and distrust propagated over the link graph of hosts, thresholded per host."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleforge.llm.common import cut

#: A host is a trusted or a blocked seed if one of its labels, or a part of a label between hyphens, is such a word.
TRUSTED = ("edu", "gov", "mil", "ac", "org", "int", "museum")
BLOCKED = ("casino", "bets", "bet", "poker", "pills", "viagra", "adult", "porn", "xxx", "sex", "spam", "warez", "malware", "phish", "ads", "adserver", "track", "tracker")
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """The host of an absolute or protocol-relative URL in lower case, without user, port and final dot; null if there is none."""
    h = F.lower(F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    h = F.regexp_replace(h, r"\.$", "")
    return F.when(h != "", h)


def _parent(host: Column) -> Column:
    """The host without its first label, if that leaves three labels or more (fewer are a registered name, which says nothing of those below)."""
    return F.when(F.size(F.split(host, r"\.")) >= 4, F.regexp_replace(host, r"^[^.]+\.", ""))


def _is_seed(host: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(host, r"[.-]"), F.array(*[F.lit(w) for w in words]))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, by number of pages, and an edge each way between a subdomain and the host above it."""
    own = pages.select(host_of(F.col("url")).alias("src"), F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)).alias("to")).filter(F.col("src").isNotNull())
    links = own.select("src", F.explode(F.array_distinct(F.transform("to", host_of))).alias("dst")).filter("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = own.select(F.col("src").alias("h")).distinct().union(links.select("dst")).distinct()
    up = hosts.select("h", _parent(F.col("h")).alias("p")).filter("p is not null")
    return links.unionByName(up.select(F.col("h").alias("src"), F.col("p").alias("dst"), F.lit(1).cast("long").alias("n"))).unionByName(up.select(F.col("p").alias("src"), F.col("h").alias("dst"), F.lit(1).cast("long").alias("n"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def host_scores(pages: DataFrame, trusted: tuple[str, ...] = TRUSTED, blocked: tuple[str, ...] = BLOCKED, damping: float = 0.85, rounds: int = 100, every: int = 5, per_seed: bool = False, seeds: DataFrame | None = None, tol: float = 1e-3) -> DataFrame:
    """(host, trust, distrust, seed) of all hosts that pages or links name.

    Seeds are the hosts of the table ``seeds`` (host, seed: 'trusted' or 'blocked'; blocked wins) or, without it, those whose
    names have one of the words ``trusted`` and ``blocked``.

    Personalised PageRank by power iteration: trust starts at the trusted seeds (blocked ones are never trusted) and
    follows links; distrust starts at the blocked seeds and goes against them. Both run in the same join, until all hosts'
    scores together change by less than ``tol`` of the seeds' own mass in ``every`` rounds. Mass of hosts
    without links isn't put back, which changes only the scale; each score is divided by its greatest or, with per_seed,
    by the mass that a seed has of its own, which no other host can move. Checkpoints cut the lineage every few rounds.
    """
    edges = cut(host_edges(pages))
    named = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").union(edges.select("src")).union(edges.select("dst")).distinct()
    if seeds is None:
        bad = _is_seed(F.col("host"), blocked)
        good = ~bad & _is_seed(F.col("host"), trusted)
    else:
        told = seeds.select(F.lower("host").alias("s"), "seed").filter(F.col("seed").isin("trusted", "blocked")).groupBy("s").agg(F.min("seed").alias("told"))
        named = named.join(told, F.col("host") == F.col("s"), "left")
        bad, good = F.col("told") == "blocked", F.col("told") == "trusted"
    hosts = cut(named.select("host", F.when(bad, "blocked").when(good, "trusted").alias("seed")))
    n = hosts.agg(F.sum((F.col("seed") == "trusted").cast("long")), F.sum((F.col("seed") == "blocked").cast("long"))).first()
    own = hosts.select("host", F.when(F.col("seed") == "trusted", 1.0 / max(1, n[0] or 0)).otherwise(0.0).alias("t"), F.when(F.col("seed") == "blocked", 1.0 / max(1, n[1] or 0)).otherwise(0.0).alias("d"))
    out = edges.groupBy(F.col("src").alias("s")).agg(F.sum("n").alias("total"))
    into = edges.groupBy(F.col("dst").alias("s")).agg(F.sum("n").alias("total"))
    ahead = edges.join(out, edges["src"] == out["s"]).select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("wt"), F.lit(0.0).alias("wd"))
    back = edges.join(into, edges["dst"] == into["s"]).select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("total")).alias("wd"))
    steps = ahead.union(back).groupBy("from", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")).repartition("from").persist(StorageLevel.MEMORY_AND_DISK)
    base = own.select("host", (F.col("t") * (1 - damping)).alias("t"), (F.col("d") * (1 - damping)).alias("d"))
    rank = last = base
    for k in range(rounds):
        moved = rank.filter("t > 0 or d > 0").join(steps, F.col("host") == F.col("from")).select(F.col("to").alias("host"), (F.col("t") * F.col("wt") * damping).alias("t"), (F.col("d") * F.col("wd") * damping).alias("d"))
        rank = base.union(moved).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        if k % every == every - 1:
            rank = cut(rank)
            was = last.select(F.col("host").alias("h"), F.col("t").alias("t0"), F.col("d").alias("d0"))
            moved = rank.join(was, F.col("host") == F.col("h"), "left").agg(F.sum(F.abs(F.col("t") - F.coalesce("t0", F.lit(0.0)))), F.sum(F.abs(F.col("d") - F.coalesce("d0", F.lit(0.0))))).first()
            if max(moved[0] or 0.0, moved[1] or 0.0) < tol * (1 - damping):
                break
            last = rank
    rank = cut(rank)
    steps.unpersist()
    top = [(1 - damping) / max(1, k or 0) for k in n] if per_seed else rank.agg(F.max("t"), F.max("d")).first()
    over = lambda c, m: F.col(c) / F.lit(m) if m else F.lit(0.0)
    return rank.join(hosts, "host").select("host", over("t", top[0]).alias("trust"), over("d", top[1]).alias("distrust"), "seed")


def filter_urls(pages: DataFrame, trusted: tuple[str, ...] = TRUSTED, blocked: tuple[str, ...] = BLOCKED, min_distrust: float = 0.01, max_share: float = 0.5, max_broadcast: int = 1_000_000, seeds: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, trust, distrust, keep) of every row of pages.

    A blocked seed is always rejected, any other host if its distrust is at least min_distrust and more than max_share
    of its trust and distrust together. Both are in units of the mass that a seed of their kind has of its own, so a
    host's verdict doesn't depend on how much others gather. Hosts that neither reaches stay. The scores are broadcast
    if there are at most max_broadcast hosts (counted first), else joined by shuffling, where adaptive execution splits
    hot hosts.

    Defined cases: a null url, or one without a host, has null host and scores and isn't kept; null html has no links; a
    link to the same host counts nothing; repeated rows stay, and count as links again; without seeds every host
    stays; seeds that no page or link names are nothing; extra columns are ignored; an empty table gives an empty table.
    """
    scores = cut(host_scores(pages, trusted, blocked, per_seed=True, seeds=seeds).withColumnRenamed("host", "h"))
    joined = pages.select("page_id", "url", host_of(F.col("url")).alias("host")).join(F.broadcast(scores) if scores.count() <= max_broadcast else scores, F.col("host") == F.col("h"), "left")
    bad = (F.col("seed") == "blocked") | (F.col("distrust") >= min_distrust) & (F.col("distrust") > F.lit(max_share) * (F.col("distrust") + F.col("trust")))
    return joined.select("page_id", "url", "host", "trust", "distrust", (F.col("host").isNotNull() & ~F.coalesce(bad, F.lit(False))).alias("keep"))
