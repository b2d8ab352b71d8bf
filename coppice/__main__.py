"""Command line.

``python -m coppice QUERY FOLDER [--top N]``  a registered query over the tables in FOLDER
``python -m coppice clones FOLDER``           exact clones of the markup files below FOLDER, largest first
``python -m coppice rules``                   the registered rules
``python -m coppice refactor FOLDER``         rewrites the files below FOLDER in place, rule by rule to a fixpoint
``python -m coppice refactor FOLDER --detect``  reports findings and writes nothing

``--only`` and ``--exclude`` choose rules (repeatable), ``--include`` files by globs. ``--dry-run``
says what would change, ``--check`` does so and ends with 1 if anything would; ``--declined`` shows
declined findings with their reasons as well. Rules that need relations which files alone do not
give (of a parsed program) are named and left out.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import clones
from coppice.plans import catalog
from coppice.session import session
from coppice.sources.files import corpus
from coppice.sources.markup import nodes


def relations_of(files: DataFrame) -> dict[str, DataFrame]:
    """What files (path, source) tell without a parser of code: lines, and the elements and fragments of their markup."""
    pages = files.select(F.xxhash64("path").alias("page_id"), F.col("source").alias("html"))
    names = files.select(F.xxhash64("path").alias("tree_id"), "path")
    lines = files.select("path", F.posexplode(F.split("source", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
    elements = nodes(pages).join(names, "tree_id")
    return {"lines": lines, "elements": elements, "fragments": clones.fragments(pages, 6, ("exact", "motif"))}


def refactor(files: DataFrame, folder: str, args: argparse.Namespace) -> int:
    """Runs the chosen rules over a corpus; changed rows stream to the driver one by one."""
    import coppice.operators.detectors
    import coppice.operators.source_rules  # noqa: F401
    from coppice.plans import engine
    from coppice.plans import findings as fnd

    known = {r.name for r in engine.rules()}
    if unknown := sorted({*args.only, *args.exclude} - known):
        print(f"no such rules: {', '.join(unknown)}")
        return 2
    asked = {name: {"enabled": True} for name in args.only}  # naming a rule turns it on
    chosen = engine.chosen(args.only, args.exclude, asked)
    if args.detect:
        relations = relations_of(files)
        able = [r for r in chosen if r.detect and not engine.lacking(r, relations)]
        for r in chosen:
            if r.detect and r not in able:
                print(f"left out: {r.name} needs {', '.join(engine.lacking(r, relations))}")
        if able:
            found = engine.detected(relations, able)
            shown = found if args.declined else fnd.accepted(found)
            for row in shown.select("rule", fnd.to_line().alias("line")).limit(args.top).toLocalIterator():
                print(f"{row.rule}\t{row.line}")
        return 0
    quiet = args.dry_run or args.check
    out = engine.rewritten(files, chosen).filter("changed")
    changed = 0
    for row in out.toLocalIterator():
        changed += 1
        print(f"{'would change' if quiet else 'changed'}\t{row.path}\t{','.join(dict.fromkeys(row.applied))}{'' if row.converged else chr(9) + 'did not settle'}")
        if not quiet:
            (Path(folder) / row.path).write_text(row.source)
    print(f"{changed} files {'would change' if quiet else 'changed'}")
    return int(args.check and changed > 0)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="coppice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--top", type=int, default=15)
    parser.add_argument("--min-mass", type=int, default=8)
    parser.add_argument("--include", action="append", default=[])
    parser.add_argument("--only", action="append", default=[])
    parser.add_argument("--exclude", action="append", default=[])
    for flag in ("--dry-run", "--check", "--detect", "--declined"):
        parser.add_argument(flag, action="store_true")
    parser.add_argument("--master", default="local[*]")
    args = parser.parse_args(argv)
    if args.what == "rules":
        import coppice.operators.detectors
        import coppice.operators.source_rules  # noqa: F401
        from coppice.plans.engine import rules

        for r in rules():
            print(f"{r.name}\t{r.priority}\t{'on' if r.enabled else 'off'}\t{'detects' if r.detect else 'rewrites'}")
        return 0
    spark = session("coppice", args.master)
    if args.what == "refactor":
        return refactor(corpus(spark, args.folder, args.include or ["**"]), args.folder, args)
    if args.what == "clones":
        files = corpus(spark, args.folder, args.include or ["**"]).withColumn("page_id", F.xxhash64("path")).withColumnRenamed("source", "html")
        found = clones.without_subsets(clones.exact_clusters(clones.fragments(files, args.min_mass)))
        places = files.select(F.col("page_id").alias("file"), "path")
        report = found.select("mode", "mass", "occurrences", "files", F.col("representative.file").alias("file"), F.col("representative.line").alias("line")).join(places, "file").drop("file")
        report.orderBy(F.desc("mass"), F.desc("occurrences"), "path", "line", "mode").show(args.top, truncate=False)
        return 0
    catalog.queries()[args.what](spark, args.folder).show(args.top, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
