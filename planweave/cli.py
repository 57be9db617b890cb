"""Command line: planweave MODULE:PIPELINE validate | manifest [--out PATH] | run [--dry] | watch | import-schemas [--out PATH] | seed FILE.

MODULE:PIPELINE names a Pipeline, or a function that returns one. Settings come from the environment, where empty means
unset: PLANWEAVE_STORAGE (on one machine file:///tmp/planweave/<name>), PLANWEAVE_NAME (the module's), PLANWEAVE_CATALOG
and PLANWEAVE_DATABASE (the session's).
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .plans import InvalidPipeline, Pipeline, Runner, RunFailed, schemas, seed, watch
from .plans.coverage import drift, report


def load(name: str) -> Pipeline:
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "pipeline")
    return found() if callable(found) else found


def setting(name: str, default: str) -> str:
    return os.environ.get(f"PLANWEAVE_{name}") or default


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="planweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("pipeline", nargs="?", help="MODULE:PIPELINE")
    commands = parser.add_subparsers(dest="command")
    commands.add_parser("validate")
    commands.add_parser("manifest").add_argument("--out", "-o")
    run = commands.add_parser("run")
    run.add_argument("--dry", action="store_true")
    run.add_argument("--full-refresh", action="store_true")
    run.add_argument("--only", nargs="*")
    run.add_argument("--timeout", type=float, default=600)
    w = commands.add_parser("watch")
    w.add_argument("--every", type=float, default=30)
    w.add_argument("--times", type=int)
    commands.add_parser("import-schemas").add_argument("--out", "-o")
    commands.add_parser("seed").add_argument("file")
    commands.add_parser("coverage")
    try:
        given = parser.parse_args(args)
    except SystemExit as e:
        return 1 if e.code else 0
    if given.command == "coverage":
        print(report())
        return 1 if drift() else 0
    if not given.pipeline or not given.command:
        parser.print_help()
        return 0
    spark = spark or SparkSession.builder.appName("planweave").getOrCreate()
    try:
        if catalog := setting("CATALOG", ""):
            try:
                spark.catalog.setCurrentCatalog(catalog)
            except Py4JJavaError as e:
                raise RuntimeError(f"catalog {catalog}: {e.java_exception.getMessage()}") from e
        if database := setting("DATABASE", ""):
            spark.catalog.setCurrentDatabase(database)
        if given.command == "seed":
            text = Path(given.file).read_text()
            print(f"{seed(spark, [s for s in text.split(';') if s.strip()])} statements")
            return 0
        name = setting("NAME", given.pipeline.partition(":")[0])
        storage = setting("STORAGE", f"file:///tmp/planweave/{name}" if spark.sparkContext.master.startswith("local") else "")
        if not storage:
            raise RuntimeError("PLANWEAVE_STORAGE must name a folder that all executors share")
        runner = Runner(spark, load(given.pipeline), storage, print, getattr(given, "timeout", 600))
        if given.command == "validate":
            print(f"valid: {len(runner.validate().order)} datasets")
        elif given.command in ("manifest", "import-schemas"):
            plan = runner.validate()
            text = runner.manifest() if given.command == "manifest" else schemas.render(plan.schemas)
            if given.out:
                Path(given.out).parent.mkdir(parents=True, exist_ok=True)
                Path(given.out).write_text(text)
            else:
                print(text, end="")
        elif given.command == "watch":
            watch(runner, given.every, given.times)
        elif given.dry:
            runner.dry_run()
        else:
            runner.run(given.only, given.full_refresh)
    except (InvalidPipeline, RunFailed, RuntimeError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
