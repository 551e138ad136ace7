"""Schemas of the four tables, title kinds and their names."""

from __future__ import annotations

from pyspark.sql import types as T

from titleforge.errors import UnknownTitle

_S, _I = T.StringType(), T.IntegerType()


def _fields(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


#: As in the files, in the order of their headers.
TITLES_RAW = _fields(tconst=_S, titleType=_S, primaryTitle=_S, originalTitle=_S, isAdult=_S, startYear=_S, endYear=_S, runtimeMinutes=_S, genres=_S)
AKAS_RAW = _fields(titleId=_S, ordering=_I, title=_S, region=_S, language=_S, types=_S, attributes=_S, isOriginalTitle=_S)
EPISODES_RAW = _fields(tconst=_S, parentTconst=_S, seasonNumber=_S, episodeNumber=_S)
RATINGS_RAW = _fields(tconst=_S, averageRating=T.FloatType(), numVotes=T.LongType())

#: As the engine uses them.
TITLES = _fields(id=_S, kind=_S, title=_S, original_title=_S, is_adult=T.BooleanType(), start_year=_I, end_year=_I, runtime_minutes=_I, genres=_S)
AKAS = _fields(id=_S, ordering=_I, title=_S, region=_S, language=_S, types=_S, attributes=_S, is_original=T.BooleanType())
EPISODES = _fields(id=_S, tvshow_id=_S, season=_I, episode=_I)
RATINGS = _fields(id=_S, rating=T.FloatType(), votes=T.LongType())

KINDS = ("movie", "short", "tvEpisode", "tvMiniSeries", "tvMovie", "tvSeries", "tvShort", "tvSpecial", "video", "videoGame")
SERIES = ("tvSeries", "tvMiniSeries")
_SYNONYMS = {"episode": "tvEpisode", "miniseries": "tvMiniSeries", "tvshow": "tvSeries", "show": "tvSeries", "special": "tvSpecial", "game": "videoGame"}
KIND_BY_NAME = {k.lower(): k for k in KINDS} | _SYNONYMS


def parse_kind(name: str) -> str:
    """A title kind by its name or a synonym, whatever the case; spaces aren't trimmed."""
    try:
        return KIND_BY_NAME[name.lower()]
    except KeyError:
        raise UnknownTitle(name) from None
