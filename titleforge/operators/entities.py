"""Look-ups and joins of titles, ratings, episodes and alternate names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.operators.search import Catalog
from titleforge.schema import SERIES


def by_id(table: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """The rows of some ids: pushed to the scan for a list, a semi-join for a table."""
    return table.join(ids, "id", "left_semi") if isinstance(ids, DataFrame) else table.filter(F.col("id").isin(list(ids)))


def in_order(episodes: DataFrame) -> DataFrame:
    """By show, season, episode and id; missing numbers last."""
    return episodes.orderBy("tvshow_id", F.asc_nulls_last("season"), F.asc_nulls_last("episode"), "id")


def by_id_order(episodes: DataFrame) -> DataFrame:
    return episodes.orderBy("id")


def seasons(episodes: DataFrame, tvshow_id: str) -> DataFrame:
    """All episodes of a show, in order."""
    return in_order(episodes.filter(F.col("tvshow_id") == tvshow_id))


def season(episodes: DataFrame, tvshow_id: str, number: int) -> DataFrame:
    """The episodes of a season; those without a number are last."""
    return in_order(episodes.filter((F.col("tvshow_id") == tvshow_id) & (F.col("season") == number)))


def grouped_akas(akas: DataFrame) -> DataFrame:
    """(id, n, names): each title's alternate names, in order."""
    return akas.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("ordering", "title", "region", "language"))).alias("names"))


def is_series(kind):
    return kind.isin(*SERIES)


def displayed(results: DataFrame, catalog: Catalog) -> DataFrame:
    """Search results as the columns of the printed table: score to 3 places, year or N/A, and for an episode its number and show."""
    show = catalog.titles.select(F.col("id").alias("show_id"), F.col("title").alias("show_title"))
    rows = catalog.with_episode(results).join(show, F.col("show") == F.col("show_id"), "left")
    tv = F.when(F.col("show_title").isNotNull(), F.format_string("S%02dE%02d %s", F.coalesce("season", F.lit(0)), F.coalesce("episode", F.lit(0)), F.col("show_title"))).otherwise("")
    return rows.select("qid", F.col("rank").alias("num"), F.format_string("%.3f", "score").alias("score"), "id", "kind", "title", F.coalesce(F.col("start_year").cast("string"), F.lit("N/A")).alias("year"), tv.alias("tv"))


def counts(catalog: Catalog) -> DataFrame:
    """The number of rows of each table, in one job."""
    tables = {k: t for k, t in {"titles": catalog.titles, "akas": catalog.akas, "episodes": catalog.episodes, "ratings": catalog.ratings}.items() if t is not None}
    out = None
    for name, t in tables.items():
        c = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out
