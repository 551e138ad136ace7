"""``python -m titleforge.cli``: search, link and evaluate from the command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from titleforge.errors import SearchError
from titleforge.functions.analysis import NgramType
from titleforge.functions.scoring import Scorer
from titleforge.functions.similarity import Similarity
from titleforge.operators import evaluate as E
from titleforge.operators.entities import displayed
from titleforge.operators.index import NameIndex, title_names
from titleforge.operators.linking import RE_EPISODE, RE_SEASON, RE_YEAR, Linker, apply_proposals, link, proposals
from titleforge.operators.search import Catalog, search
from titleforge.query import Query
from titleforge.sources.paths import aligned, collect_paths
from titleforge.sources.tsv import missing_tables, read_table, rewrite

log = logging.getLogger("titleforge")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="titleforge")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search titles, or link files to them")
    s.add_argument("files", nargs="*")
    s.add_argument("-q", "--query")
    s.add_argument("-d", "--dest-dir", default=os.environ.get("TITLEFORGE_DEST_DIR"))
    s.add_argument("-f", "--follow", action="store_true")
    s.add_argument("--index-dir", default=os.environ.get("TITLEFORGE_INDEX_DIR"))
    s.add_argument("--update-index", action="store_true")
    s.add_argument("--ngram-size", type=int, default=3)
    s.add_argument("--ngram-type", type=NgramType.parse, default=NgramType.WINDOW)
    s.add_argument("--re-season", default=RE_SEASON)
    s.add_argument("--re-episode", default=RE_EPISODE)
    s.add_argument("--re-year", default=RE_YEAR)
    s.add_argument("--votes", type=int, default=1000)
    s.add_argument("--apply", action="store_true", help="carry the proposals out")
    how = s.add_mutually_exclusive_group()
    how.add_argument("-s", "--symlink", action="store_true")
    how.add_argument("-H", "--hardlink", action="store_true")
    e = sub.add_parser("eval", help="evaluate search settings")
    e.add_argument("--truth", help="a TOML file of tasks (default: the tasks that come with this package)")
    e.add_argument("--eval-dir", help="where the indexes are saved and looked for")
    e.add_argument("--dry-run", action="store_true")
    e.add_argument("--summarize", metavar="CSV")
    e.add_argument("--ngram-size", type=int, action="append")
    e.add_argument("--ngram-type", type=NgramType.parse, action="append")
    e.add_argument("--result-size", type=int, action="append")
    e.add_argument("--sim", type=Similarity.parse, action="append")
    e.add_argument("--scorer", type=lambda x: None if x == "none" else Scorer.parse(x), action="append")
    e.add_argument("--out")
    for x in (s, e):
        x.add_argument("--debug", action="store_true")
        x.add_argument("--update-data", action="store_true", help="drop lines that repeat a key from the tables in the data folder, and the index made of them")
        x.add_argument("--data-dir", default=os.environ.get("TITLEFORGE_DATA_DIR", "data"))
    return p


def catalog(spark: SparkSession, args: argparse.Namespace, indexed: bool) -> Catalog:
    if missing := missing_tables(args.data_dir):
        sys.exit(f"{args.data_dir} lacks {', '.join(missing)}")
    if args.update_data:
        for n in ("titles", "akas", "episodes", "ratings"):
            log.debug("rewriting %s", n)
            rewrite(spark, args.data_dir, n)
    t = {n: read_table(spark, args.data_dir, n) for n in ("titles", "akas", "episodes", "ratings")}
    index = None
    if indexed:
        at = args.index_dir
        if at and (args.update_index or args.update_data or not os.path.exists(at)):
            NameIndex.build(title_names(t["titles"], t["akas"]), args.ngram_type, args.ngram_size).save(at)
        index = NameIndex.load(spark, at) if at else NameIndex.build(title_names(t["titles"], t["akas"]), args.ngram_type, args.ngram_size)
    return Catalog(t["titles"], index, t["akas"], t["episodes"], t["ratings"])


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.WARNING, format="%(levelname)s %(name)s: %(message)s")
    log.setLevel(logging.DEBUG if args.debug else logging.WARNING)
    try:
        run(args)
        sys.stdout.flush()
    except BrokenPipeError:  # whoever read the output has seen enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    except SearchError as e:
        if args.debug:
            raise
        sys.exit(f"{e}" + (f": {e.__cause__}" if e.__cause__ else ""))


def run(args: argparse.Namespace) -> None:
    if args.command == "eval":
        specs = E.grid(args.ngram_size or (3,), args.result_size or (30,), args.sim or tuple(Similarity), args.scorer or tuple(Scorer), args.ngram_type or (NgramType.WINDOW,))
        if args.dry_run:
            print("\n".join(map(str, specs)))
            return
        spark = SparkSession.builder.getOrCreate()
        if args.summarize:
            E.summarize(E.read_results(spark, args.summarize)).show(1000, False)
            return
        results = E.evaluate(catalog(spark, args, False), specs, E.load_truth(args.truth), index_dir=args.eval_dir)
        if args.out:
            E.write_results(results, args.out)
        else:
            E.summarize(results).show(1000, False)
        return
    spark = SparkSession.builder.getOrCreate()
    c = catalog(spark, args, True)
    if args.query is not None and not args.files:
        print(aligned(displayed(search(c, [("0", Query.parse(args.query))]), c)))
        return
    force = None
    if args.query is not None:
        best = search(c, [("0", Query.parse(args.query))]).filter("rank = 1").first()
        force = best and best["id"]
    action = "symlink" if args.symlink else "hardlink" if args.hardlink else "rename"
    linker = Linker(force, args.votes, season=args.re_season, episode=args.re_episode, year=args.re_year)
    p = proposals(link(c, collect_paths(spark, args.files, args.follow), linker), args.dest_dir, action)
    for r in p.collect():
        print(f"{r['src']} -> {r['dst']}")
    if args.apply:
        apply_proposals(p, action)


if __name__ == "__main__":
    main()
