"""Command line: ``python -m recollect.cli recall "a question" --project p``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from recollect import __version__
from recollect.engine import Engine


def home() -> str:
    return os.environ.get("RECOLLECT_HOME") or os.path.join(os.path.expanduser("~"), ".recollect")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="recollect", description="Semantic retrieval on Spark")
    parser.add_argument("--version", "-v", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=help)
        if name not in ("projects", "db", "version"):
            sub.add_argument("--project", required=name == "ingest")
        return sub

    remember = command("remember", "store a note")
    remember.add_argument("text", nargs="+")
    remember.add_argument("--tags")
    recall = command("recall", "search a project")
    recall.add_argument("query", nargs="+")
    recall.add_argument("--limit", type=int, default=5)
    recall.add_argument("--max-tokens", type=int)
    recall.add_argument("--min-score", type=float)
    listed = command("list", "newest memories first")
    listed.add_argument("--tag")
    listed.add_argument("--limit", type=int, default=20)
    listed.add_argument("--kind", choices=["manual", "code"])
    command("forget", "delete one memory").add_argument("id", type=int)
    ingest = command("ingest", "index a source tree")
    ingest.add_argument("path")
    ingest.add_argument("--include")
    ingest.add_argument("--exclude")
    ingest.add_argument("--dry-run", action="store_true")
    command("projects", "projects with counts")
    command("db", "where the data is")
    command("version", "the version")
    return parser


def run(engine: Engine, args: argparse.Namespace) -> int:
    if args.command == "remember":
        answer = engine.remember(" ".join(args.text).strip(), args.tags, args.project)
    elif args.command == "recall":
        found = engine.recall(" ".join(args.query).strip(), args.limit, args.project, args.max_tokens, args.min_score)
        answer = found.split("\n", 1)[1] if found.startswith("# ") else found
    elif args.command == "list":
        found = engine.list_memories(args.limit, args.tag, args.project, args.kind, width=160)
        answer = found.split("\n", 1)[1] if found.startswith("# ") else found
    elif args.command == "forget":
        answer = engine.forget(args.id, args.project)
        if answer.startswith("No memory"):
            print(answer, file=sys.stderr)
            return 1
    elif args.command == "ingest":
        answer = engine.ingest_codebase(args.path, args.project, args.include, args.exclude, dry_run=args.dry_run)
    else:
        answer = engine.list_projects()
    print(answer)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "db":
        print(f"memories: {home()}/memories\nmanifest: {home()}/manifest")
        return 0
    spark = SparkSession.builder.appName("recollect").getOrCreate()
    if not os.environ.get("RECOLLECT_HOME") and not spark.sparkContext.master.startswith("local"):
        spark.stop()
        raise SystemExit("set RECOLLECT_HOME to a folder that all machines share")
    try:
        return run(Engine(spark, home()), args)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
