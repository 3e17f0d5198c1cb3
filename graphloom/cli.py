"""Command line: ``python -m graphloom.cli analyze PATH [-o text|json|viewer] [-i PATTERN ...]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from graphloom.plans.analyze import analyze_directory
from graphloom.plans.report import empty_json_report, json_lines, text_lines, viewer_json
from graphloom.schema import AnalyzerOptions


def analyze(spark: SparkSession, path: str, output: str = "text", ignore: list[str] | None = None) -> int:
    """Prints the report; the exit code is 1 if there are cycles or an error, else 0."""
    root = os.path.abspath(path)
    if output == "text":
        print(f"\nAnalyzing: {root}\n")
    try:
        result = analyze_directory(spark, root, AnalyzerOptions(ignore_patterns=ignore or []))
        if result.graph.nodes.isEmpty():
            print("No TypeScript/JavaScript files found." if output == "text" else empty_json_report(result))
            return 0
        if output == "viewer":
            print(viewer_json(result))
        else:
            lines = json_lines(result, root).orderBy("part", "nth") if output == "json" else text_lines(result, root).orderBy("nth")
            # one range of the sorted lines at a time
            for row in lines.select("text").toLocalIterator():
                print(row["text"])
        return int(not result.cycles.isEmpty())
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description="Finds circular dependencies in TypeScript and JavaScript code.")
    command = parser.add_subparsers(dest="command", required=True).add_parser("analyze", help="analyze a directory")
    command.add_argument("path")
    command.add_argument("-o", "--output", default="text", help="text, json or viewer")
    command.add_argument("-i", "--ignore", nargs="*", default=[], help="patterns to ignore, in addition to the defaults")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return analyze(spark, args.path, args.output, args.ignore)


if __name__ == "__main__":
    sys.exit(main())
