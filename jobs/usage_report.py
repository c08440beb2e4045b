"""Keeps a daily report of a growing log of requests: how many of each kind, by how many users, and how fast.

    spark-submit jobs/usage_report.py --events PATH --report PATH [--config FILE]

`events` are Parquet files (ts, user_id, event_type, value) that only grow; value times `unit_ms` is a request's latency.
`report` is partitioned by day and is its own mark: it says how many events of each day it counts. A run counts the events
of each day, for which it reads no column but the time, and reports anew, from all their events, the days that have more
than the report counts, however late these came; only their events are read and only their partitions overwritten. Days
that have left the log stay in the report. Running again on the same log writes nothing.

Defined results: events without a time are left out and counted in the log; those without a kind, user or value are
counted, under a kind that is null, as no user, and in no latency. Days are those of the session's time zone.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path[0] = str(Path(__file__).resolve().parent.parent)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import metrics, rules
from jobs.common import log, main, written

REPORT = "kind string, n bigint, users bigint, mean double, least double, most double, fast bigint, mid bigint, slow bigint, day date"


@dataclass(frozen=True)
class Config:
    """Milliseconds that a value of 1 stands for."""

    unit_ms: float = 100.0


def due_days(events: DataFrame, report: DataFrame | None) -> DataFrame:
    """(day, n) of the days of which the report counts fewer events than there are, or none; and null for no time."""
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    if report is None:
        return days
    counted = report.groupBy(F.col("day").alias("counted_day")).agg(F.sum("n").alias("counted"))
    return days.join(counted, F.col("day") == F.col("counted_day"), "left").where("counted is null or n > counted").select("day", "n")


def daily(events: DataFrame, config: Config) -> DataFrame:
    x = events.select(F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), "user_id", (F.col("value") * config.unit_ms).alias("ms"))
    tiers = [F.count_if(F.col("ms").isNotNull() & (rules.latency_tier(F.col("ms")) == f"latency-{t}")).alias(t) for t in ("fast", "mid", "slow")]
    return x.groupBy("day", "kind").agg(*metrics.latencies("ms"), F.countDistinct("user_id").alias("users"), *tiers).select(*(c.split()[0] for c in REPORT.split(", ")))


def run(spark: SparkSession, events_path: str, report_path: str, config: Config = Config()) -> DataFrame:
    """Brings the report up to date, and gives it as it then stands."""
    events = spark.read.parquet(events_path)
    report = written(spark, report_path, REPORT)
    due = due_days(events, report).collect()  # a row for each day
    nameless = sum(r["n"] for r in due if r["day"] is None)
    days = sorted(r["day"] for r in due if r["day"] is not None)
    log.info("usage: %s has %d days with new events, and %d events without a time", events_path, len(days), nameless)
    if days:
        of_days = events.where((F.col("ts") >= F.lit(days[0])) & (F.col("ts") < F.date_add(F.lit(days[-1]), 1))).where(F.to_date("ts").isin(days))
        daily(of_days, config).repartition("day").sortWithinPartitions("day", "kind").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(report_path)
        log.info("usage: read %d events, wrote %d days from %s to %s to %s", sum(r["n"] for r in due) - nameless, len(days), days[0], days[-1], report_path)
    report = written(spark, report_path, REPORT)
    return spark.createDataFrame([], REPORT) if report is None else report


if __name__ == "__main__":
    main("usage_report", __doc__, ["events", "report"], Config, run)
