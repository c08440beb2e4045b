"""Append-only logs that are written by streams: a Parquet table and its CSV export, each row in both exactly once.

A batch of a stream keeps its number and its rows when it is run again, and both sinks hold it as a partition of that
number, which a further run overwrites. A run that was stopped between or within the two is made good by the restart from
the checkpoint. Partitions are whole batches, so that their size is set by the trigger and by how much a batch may take.

An export that was switched on later, or has been lost, is filled from the table by `back_fill`: batches that it lacks, or
holds another number of rows of, are written anew. It may be stopped and run again too, and before or after the stream.

Defined results: null values come back as nulls and empty ones as empty; a batch without rows leaves no partition; line
ends have to be taken out by the projection, as the export has one row a line, with a header at the top of each file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import held

#: Batches whose numbers are sent to a scan as literals; beyond, they are joined.
MOST_BATCHES = 1000
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}
#: A blank is null and a quoted blank is empty; by default, both would be null.
_READ = {"nullValue": "\0", "emptyValue": ""}


@dataclass(frozen=True)
class Log:
    """Where a log is: table takes all columns, export (None: not switched on) those of the projection, both by order."""

    table: str
    schema: str
    order: str
    export: str | None = None
    export_schema: str = ""
    project: Callable[[DataFrame], DataFrame] = lambda rows: rows


def table(spark: SparkSession, log: Log) -> DataFrame:
    return held(spark, log.table, f"{log.schema}, batch bigint")


def export(spark: SparkSession, log: Log) -> DataFrame:
    return held(spark, log.export, f"{log.export_schema}, batch bigint", "csv", **_CSV, **_READ)


def _write(rows: DataFrame, path: str, form: str) -> None:
    w = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
    w.format(form).options(**(_CSV if form == "csv" else {})).save(path)


def _export(rows: DataFrame, log: Log) -> None:
    """rows(..., batch) as lines of the export, in order within the files."""
    lines = log.project(rows.sortWithinPartitions("batch", log.order))
    _write(lines, log.export, "csv")


def append(log: Log, stream: DataFrame, checkpoint: str) -> None:
    """Takes what the stream has, until it has taken all that is there, and ends. The export is written from the table, so
    that a source which can't give the same rows again has been read once."""
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        _write(batch.withColumn("batch", F.lit(number).cast("bigint")), log.table, "parquet")
        if log.export is not None:
            _export(table(spark, log).where(F.col("batch") == number), log)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def lacking(spark: SparkSession, log: Log) -> DataFrame:
    """(batch) of the table that the export doesn't hold with as many rows."""
    counts = lambda x: x.groupBy("batch").agg(F.count("*").alias("rows"))
    return counts(table(spark, log)).join(counts(export(spark, log)), ["batch", "rows"], "left_anti").select("batch")


def back_fill(spark: SparkSession, log: Log) -> int:
    """Writes the batches that the export lacks; gives their number. The driver gets MOST_BATCHES numbers at most, and more
    batches are found by a join."""
    due = lacking(spark, log).persist()
    try:
        n = due.count()
        if n:
            rows = table(spark, log)
            few = [r["batch"] for r in due.collect()] if n <= MOST_BATCHES else None
            rows = rows.join(due, "batch", "left_semi") if few is None else rows.where(F.col("batch").isin(few))
            _export(rows, log)
        return n
    finally:
        due.unpersist()
