"""What the jobs share: settings from a JSON file, the command line, and reading back what was written."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(kind: type, path: str | None, **paths: str) -> Any:
    """An instance of the dataclass ``kind`` from a JSON file of its fields; names that it doesn't have are errors."""
    given: dict = {}
    if path is not None:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    known = {f.name for f in dataclasses.fields(kind)}
    if odd := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return kind(**given | paths)


def main(kind: type, run: Callable, about: str, paths: list[str]) -> None:
    """Parse the command line, make a session, run, stop it."""
    parser = argparse.ArgumentParser(description=about)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path that Spark can open")
    parser.add_argument("--config", help="JSON file with settings")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    wanted = settings(kind, args.pop("config"), **args)
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, wanted)
    finally:
        spark.stop()
