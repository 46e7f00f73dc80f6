"""What the command lines share: arguments, settings from a JSON file, a session, logging."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from pathlib import Path

HERE = Path(__file__).resolve().parent


def settings(kind: type, path: str | None = None):
    """The settings of a job from a JSON file; a name that the job does not know is an error."""
    given = json.loads(Path(path).read_text()) if path else {}
    unknown = set(given) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def main(name: str, told: str, kind: type, run: Callable, paths: dict[str, str], args: list[str] | None = None) -> None:
    """Run a job from the command line; the session is this call's own and ends with it."""
    parser = argparse.ArgumentParser(prog=name, description=told.strip().split("\n")[0])
    for path, what in paths.items():
        parser.add_argument(path, help=what)
    parser.add_argument("--config", default=str(HERE / f"{name}.json"), help="JSON file of settings")
    got = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(getattr(got, p) for p in paths), settings(kind, got.config))
    finally:
        spark.stop()
