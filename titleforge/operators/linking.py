"""Linking file paths to titles: candidates from paths, batch search, choice, proposals of new names."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from titleforge.errors import LinkError
from titleforge.functions import analysis as A
from titleforge.functions.scoring import Scorer
from titleforge.operators.search import PARAMS, Catalog, Need, search_by_name
from titleforge.schema import KINDS, SERIES

RE_SEASON = r"(?:s|S)(?P<season>\d\d)"
RE_EPISODE = r"(?:e|E)(?P<episode>\d\d)"
RE_YEAR = r"\b(?P<year>\d\d\d\d)\b"
ANY_KINDS = tuple(k for k in KINDS if k not in ("tvEpisode", "videoGame"))


@dataclass(frozen=True)
class Linker:
    """How to link. ``force`` is an id that all paths are linked to; good_threshold the lead that settles a choice."""

    force: str | None = None
    min_votes: int = 1000
    good_threshold: float = 0.25
    season: str = RE_SEASON
    episode: str = RE_EPISODE
    year: str = RE_YEAR
    stop_ratio: float = 0.01


def candidates(paths: DataFrame, linker: Linker = Linker()) -> DataFrame:
    """paths (path, is_dir) with base, ext, form ('episode', 'any', 'unknown'), raw_title, name, season, episode, year.

    A season and an episode in the name make an episode, titled by what precedes the season; else a year makes
    anything of that year, titled by what precedes it; else the form is unknown.
    """
    base = A.path_base(F.col("path"))
    p = paths.select("path", "is_dir", A.path_parent(F.col("path")).alias("parent"), base.alias("base"), A.path_extension(base, F.col("is_dir")).alias("ext"))
    p = p.withColumn("s", A.extract(F.col("base"), linker.season, "season").cast("int")).withColumn("e", A.extract(F.col("base"), linker.episode, "episode").cast("int")).withColumn("y", A.extract(F.col("base"), linker.year, "year").cast("int"))
    form = F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), "episode").when(F.col("y").isNotNull(), "any").otherwise("unknown")
    p = p.withColumn("form", form)
    raw = F.when(F.col("form") == "episode", A.before_match(F.col("base"), linker.season)).when(F.col("form") == "any", A.before_match(F.col("base"), linker.year))
    ep = F.col("form") == "episode"
    return p.withColumn("raw_title", raw).select("path", "is_dir", "parent", "base", "ext", "form", "raw_title", A.clean_query_name(F.col("raw_title")).alias("name"), F.when(ep, F.col("s")).alias("season"), F.when(ep, F.col("e")).alias("episode"), F.when(F.col("form") == "any", F.col("y")).alias("year"))


def candidate_queries(found: DataFrame, linker: Linker = Linker()) -> DataFrame:
    """The distinct queries of candidates as parameters; the qid tells form, name and year, so equal ones are searched once."""
    q = found.filter("form <> 'unknown'").select(qid_of().alias("qid"), "form", "name", "year").distinct()
    kinds = F.when(F.col("form") == "episode", F.array(*[F.lit(k) for k in SERIES])).otherwise(F.array(*[F.lit(k) for k in ANY_KINDS]))
    none = {c.split(" ")[0]: c.split(" ")[1] for c in PARAMS.split(", ")}
    filled = {"name": F.col("name"), "size": F.lit(30), "kinds": kinds, "year_lo": F.col("year"), "year_hi": F.col("year"), "votes_lo": F.lit(linker.min_votes).cast("long")}
    return q.select("qid", *[filled.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items() if c != "qid"])


def qid_of():
    return F.concat_ws("\x1f", "form", F.coalesce(F.col("name"), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")))


def choose(results: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(qid, id, status) of each query with results: 'auto' if there is one or the first leads the second by the threshold, else 'ambiguous' (and no id)."""
    w = Window.partitionBy("qid").orderBy("rank")
    lead = results.withColumn("second", F.lead("score").over(w)).filter("rank = 1")
    auto = F.col("second").isNull() | (F.col("score") - F.col("second") >= threshold)
    return lead.select("qid", F.when(auto, F.col("id")).alias("id"), F.when(auto, "auto").otherwise("ambiguous").alias("status"))


def link(catalog: Catalog, paths: DataFrame, linker: Linker = Linker()) -> DataFrame:
    """(path, is_dir, parent, ext, form, status, id, new_base): what each path is linked to.

    status: 'auto', 'ambiguous' (somebody must choose), 'none' (nothing found). An episode is found through its show,
    season and number (the least id of several). A forced id takes the place of the search; episodes need it to be a series.
    """
    found = candidates(paths, linker)
    if linker.force is None:
        params = candidate_queries(found, linker)
        chosen = choose(search_by_name(catalog, params, Need(True, True, True, False), Scorer.OKAPI_BM25, stop_ratio=linker.stop_ratio), linker.good_threshold)
        j = found.withColumn("qid", F.when(F.col("form") != "unknown", qid_of())).join(chosen, "qid", "left").drop("qid")
    else:
        forced = catalog.titles.filter(F.col("id") == linker.force).select(F.col("id"), F.col("kind").isin(*SERIES).alias("series"))
        if not forced.head(1):
            raise LinkError(f"there is no title {linker.force!r}")
        j = found.join(F.broadcast(forced)).withColumn("status", F.when((F.col("form") != "episode") | F.col("series"), F.lit("auto")))
        j = j.withColumn("id", F.when(F.col("status") == "auto", F.col("id"))).drop("series")
    numbered = catalog.episodes.groupBy(F.col("tvshow_id").alias("show"), F.col("season").alias("sn"), F.col("episode").alias("en")).agg(F.min("id").alias("ep_id"))
    j = j.join(numbered, (F.col("form") == "episode") & (F.col("id") == F.col("show")) & (F.col("season") == F.col("sn")) & (F.col("episode") == F.col("en")), "left")
    target = F.when(F.col("form") == "episode", F.col("ep_id")).otherwise(F.col("id"))
    j = j.withColumn("target", target).drop("show", "sn", "en", "ep_id", "id")
    t = catalog.titles.select(F.col("id").alias("target"), "kind", "title", "start_year")
    j = j.join(t, "target", "left")
    status = F.when(F.col("status") == "ambiguous", "ambiguous").when(F.col("kind").isNull(), "none").otherwise("auto")
    new = A.display_name(F.col("kind"), F.col("title"), F.col("start_year"), F.col("season"), F.col("episode"), F.col("ext"))
    return j.select("path", "is_dir", "parent", "ext", "form", status.alias("status"), F.col("target").alias("id"), F.when(status == "auto", new).alias("new_base"))


def proposals(linked: DataFrame, dest_dir: str | None = None, action: str = "rename", check_exists: bool = True) -> DataFrame:
    """(src, dst) of the paths that would change, longest destination first if there are directories.

    New names go to dest_dir; else files that are renamed stay in their own folder, and links are made in the folder
    one is in. The source of a symbolic link into dest_dir is an absolute path, else it wouldn't be found from there.
    Raises if two would be the same file, or (looked up on the driver) if there is a file of that name already.
    """
    if dest_dir is None and action != "rename":
        dest_dir = os.getcwd()
        src = F.col("path")
    else:
        absolute = dest_dir is not None and action == "symlink"
        src = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(os.getcwd() + "/"), F.col("path"))) if absolute else F.col("path")
    folder = F.lit(dest_dir) if dest_dir is not None else F.col("parent")
    dst = F.when(folder == "", F.col("new_base")).otherwise(F.concat(folder, F.lit("/"), F.col("new_base")))
    p = linked.filter("status = 'auto'").select(src.alias("src"), dst.alias("dst"), "is_dir").filter("src <> dst").persist()  # looked at four times
    twice = duplicate_destinations(p).head(1)
    if twice:
        raise LinkError(f"several files would become {twice[0]['dst']!r}")
    if check_exists:
        for r in p.select("dst").toLocalIterator():
            if os.path.lexists(r["dst"]):
                raise LinkError(f"{r['dst']!r} exists already")
    order = [F.desc(F.length("dst")), "dst"] if p.filter("is_dir").head(1) else ["dst"]
    return p.orderBy(*order).select("src", "dst")


def duplicate_destinations(p: DataFrame) -> DataFrame:
    return p.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def apply_proposals(p: DataFrame, action: str = "rename") -> int:
    """Carry proposals out on the driver's file system ('rename', 'symlink', 'hardlink'); refuses to overwrite. Never runs in tasks."""
    todo = [(r["src"], r["dst"]) for r in p.collect()]
    for _, dst in todo:
        if os.path.lexists(dst):
            raise LinkError(f"{dst!r} exists already")
    do = {"rename": os.rename, "symlink": lambda s, d: os.symlink(os.path.abspath(s), d), "hardlink": os.link}[action]
    for src, dst in todo:
        do(src, dst)
    return len(todo)
