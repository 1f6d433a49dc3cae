"""What the jobs' command lines share."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("groundsearch.jobs")


def settings(defaults: Mapping, given: Mapping) -> dict:
    """The defaults with what is given; a name that no job setting has is an error."""
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {**defaults, **given}


def load(path: str | None) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8")) if path else {}


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
