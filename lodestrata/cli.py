"""Command line: ``view NAME`` prints a view of a source tree, ``export sqlite FILE`` writes views into a database."""

from __future__ import annotations

import argparse
import csv
import sys

from pyspark.sql import DataFrame

from lodestrata.operators.extract import builtin_pack
from lodestrata.plans.engine import Analysis, Engine, Extension, PackExtension, select_views, snippets_extension
from lodestrata.session import build_session
from lodestrata.sources.filetree import read_tree
from lodestrata.sources.gitlog import commit_parts, raw_commits, read_logs
from lodestrata.sources.sinks import render, save_sqlite

#: Views that only show with their extension.
NEEDS = {"component_cycles_elementary": "cycles", "component_cycles_largest": "cycles"}


class Listed(argparse.Action):
    """Values of a flag that may be given more than once, each a list parted by commas."""

    def __call__(self, parser, namespace, values, option_string=None):
        row = next(csv.reader([values], skipinitialspace=True), [])
        setattr(namespace, self.dest, [*getattr(namespace, self.dest), *[x for x in row if x]])


def extensions_of(names: list[str], patterns: list[str], more: list[Extension] | None = None) -> list[Extension]:
    out: list[Extension] = list(more or [])
    out += [PackExtension(builtin_pack(n)) for n in names if n not in ("git", "cycles")]
    return out + ([snippets_extension(patterns)] if patterns else [])


def analysis(args: argparse.Namespace, more: list[Extension] | None = None) -> Analysis:
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, extensions_of(args.extension, args.snippet, more), spaces=args.spaces, based_on=args.based_on)
    for view, extension in NEEDS.items():
        if extension not in args.extension:
            engine.views.pop(view)
    parts: DataFrame | None = None
    if "git" in args.extension:
        parts = commit_parts(raw_commits(read_logs(spark, args.working_dir)))
    else:
        engine.views = {k: v for k, v in engine.views.items() if not k.startswith("git_")}
    return engine.analyze(read_tree(spark, args.working_dir), parts)


def main(argv: list[str] | None = None, more: list[Extension] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestrata")
    parser.add_argument("-f", "--working-dir", default=".")
    parser.add_argument("-e", "--extension", action=Listed, default=[])
    parser.add_argument("-s", "--snippet", action="append", default=[])
    parser.add_argument("--spaces", type=int, default=4)
    parser.add_argument("--based-on")
    commands = parser.add_subparsers(dest="command", required=True)
    view = commands.add_parser("view")
    view.add_argument("name")
    view.add_argument("-c", "--column", action=Listed, default=[])
    view.add_argument("--sorted-by")
    view.add_argument("-o", "--output-format", default="table")
    view.add_argument("--no-header", action="store_true")
    export = commands.add_parser("export").add_subparsers(dest="target", required=True).add_parser("sqlite")
    export.add_argument("file")
    export.add_argument("--report-id", required=True)
    export.add_argument("--include", action=Listed, default=[])
    export.add_argument("--exclude", action=Listed, default=[])
    args = parser.parse_args(argv)
    try:
        a = analysis(args, more)
        if args.command == "view":
            for line in render(a.view(args.name, args.column, args.sorted_by), args.output_format, not args.no_header):
                print(line)
        else:
            names = select_views(sorted(a.engine.views), args.include, args.exclude)
            save_sqlite(args.file, {n: a.view(n) for n in names}, args.report_id)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
