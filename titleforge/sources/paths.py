"""Paths to link, from arguments or a walk on the driver; and results as an aligned text table."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def collect_paths(spark: SparkSession, paths: Iterable[str], follow: bool = False) -> DataFrame:
    """(path, is_dir): the given paths, or with ``follow`` all that is below them too."""
    rows = []
    for p in paths:
        rows.append((p, os.path.isdir(p)))
        if follow and os.path.isdir(p):
            for folder, dirs, files in os.walk(p):
                rows += [(os.path.join(folder, d), True) for d in sorted(dirs)] + [(os.path.join(folder, f), False) for f in sorted(files)]
    return spark.createDataFrame(rows, "path string, is_dir boolean")


def aligned(shown: DataFrame) -> str:
    """The rows of operators.entities.displayed as a table with aligned columns, for a terminal."""
    head = ["#", "score", "id", "kind", "title", "year", "tv"]
    rows = [head] + [[str(r[c]) for c in ("num", "score", "id", "kind", "title", "year", "tv")] for r in shown.orderBy("qid", "num").collect()]
    widths = [max(len(r[k]) for r in rows) for k in range(len(head))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)
