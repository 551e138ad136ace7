"""Text analysis as column expressions: normalisation, n-grams, term frequencies, path and name handling."""

from __future__ import annotations

import re
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleforge.errors import ConfigError, UnknownNgramType
from titleforge.schema import KIND_BY_NAME

MAX_TF, MAX_LENGTH = 15, 65535


class NgramType(str, Enum):
    WINDOW = "window"
    EDGE = "edge"

    @classmethod
    def parse(cls, name: str) -> "NgramType":
        try:
            return cls(name)
        except ValueError:
            raise UnknownNgramType(name) from None

    def __str__(self) -> str:
        return self.value


def normalize(text: Column) -> Column:
    """Lower case; nothing else."""
    return F.lower(text)


def window_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters; a shorter text is one gram itself; '' or n = 0 gives none."""
    none = F.array().cast("array<string>")
    if n <= 0:
        return F.when(text.isNotNull(), none)
    last = F.greatest(F.lit(1), F.char_length(text) - (n - 1))
    return F.when(F.char_length(text) == 0, none).when(text.isNotNull(), F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))


def edge_ngrams(text: Column, longest: int) -> Column:
    """Of each word the prefixes of 3 (or all, if it is shorter) to ``longest`` characters; the first always."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def prefixes(w: Column) -> Column:
        low = F.least(F.lit(3), F.char_length(w))
        high = F.greatest(low, F.least(F.lit(longest), F.char_length(w)))
        return F.transform(F.sequence(low, high), lambda k: F.substring(w, F.lit(1), k))

    return F.flatten(F.transform(words, prefixes))


def ngrams(text: Column, kind: NgramType, n: int) -> Column:
    return window_ngrams(text, n) if kind is NgramType.WINDOW else edge_ngrams(text, n)


def counted(rows: DataFrame, grams: Column, keep: list[str]) -> DataFrame:
    """keep, ``length`` (the number of grams) and ``counts``: array<struct<term, tf>> of the distinct grams.

    Counting sorts the grams within the row and compares neighbours, so it needs no shuffle and about linear time.
    Each step is a projection of its own: what a lambda uses is then computed once a row.
    """
    d = rows.select(*keep, F.sort_array(F.coalesce(grams, F.array().cast("array<string>"))).alias("g"))
    starts = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    d = d.select(*keep, "g", F.when(F.size("g") > 0, starts).otherwise(F.array().cast("array<int>")).alias("p"))
    runs = F.transform("p", lambda i, k: F.struct(F.get("g", i).alias("term"), (F.coalesce(F.get("p", k + 1), F.size("g")) - i).alias("tf")))
    return d.select(*keep, F.size("g").alias("length"), runs.alias("counts"))


def clean_query_name(name: Column) -> Column:
    """A name taken from a path as a query: dots are spaces, ends are trimmed."""
    return F.trim(F.regexp_replace(name, r"\.", " "))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[\x00/]", "_")


def java_pattern(pattern: str) -> str:
    """A pattern with Python's or Rust's named groups in Java's syntax."""
    return pattern.replace("(?P<", "(?<")


def group_index(pattern: str, name: str) -> int:
    """The number of a named group, which Spark's regular expression functions need."""
    try:
        return re.compile(pattern if "(?P<" in pattern else re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groupindex[name]
    except re.error as e:
        raise ConfigError(f"bad pattern {pattern!r}: {e}") from e
    except KeyError:
        raise ConfigError(f"pattern {pattern!r} has no group {name!r}") from None


def extract(text: Column, pattern: str, name: str) -> Column:
    """The named group of the first match; null if nothing matches."""
    p = java_pattern(pattern)
    return F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, p, group_index(pattern, name)))


def before_match(text: Column, pattern: str) -> Column:
    """What precedes the first match; null if nothing matches."""
    p = java_pattern(pattern)
    return F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, rf"(?s)^(.*?)(?:{p})", 1))


def path_parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_extension(base: Column, is_dir: Column) -> Column:
    """What follows the last dot of a file's name, null if there is no dot but a leading one; directories have none."""
    return F.when(~is_dir & F.regexp_like(base, F.lit(r"^.+\.[^.]*$")), F.regexp_extract(base, r"\.([^.]*)$", 1))


def display_name(kind: Column, title: Column, year: Column, season: Column, episode: Column, ext: Column) -> Column:
    """``SxxEyy - Title`` of an episode (0 for a number that is missing), else ``Title (year)`` or ``Title``; then the extension."""
    numbered = F.format_string("S%02dE%02d - %s", F.coalesce(season, F.lit(0)), F.coalesce(episode, F.lit(0)), title)
    name = F.when(kind == "tvEpisode", numbered).when(year.isNotNull(), F.format_string("%s (%d)", title, year)).otherwise(title)
    return F.concat(safe_file_name(name), F.when(ext.isNotNull(), F.concat(F.lit("."), ext)).otherwise(F.lit("")))


def kind_of(name: Column) -> Column:
    """The title kind by name or synonym, null if unknown."""
    pairs = reduce(lambda a, kv: [*a, F.lit(kv[0]), F.lit(kv[1])], KIND_BY_NAME.items(), [])
    return F.element_at(F.create_map(*pairs), F.lower(name))
