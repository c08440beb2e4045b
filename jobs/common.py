"""What the jobs share: their command line, configuration read by Spark, and a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("docweave.jobs")


def configured(spark: SparkSession, path: str, kind: type):
    """The configuration at path, a JSON object; names that the job does not have are an error."""
    return kind(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at path, or None before anything was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def main(name: str, doc: str, paths: list[str], kind: type, run: Callable) -> None:
    """Runs a job from the command line: --<path> for each of its paths, and --config."""
    args = argparse.ArgumentParser(prog=name, description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    for p in paths:
        args.add_argument(f"--{p}", required=True)
    args.add_argument("--config", default=Path(__file__).with_name(f"{name}.json").as_uri(), help="a JSON file that Spark can read; the one beside the job if left out")
    given = vars(args.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *(given[p] for p in paths), configured(spark, given["config"], kind))
    finally:
        spark.stop()
