"""Ingest that writes: points of a corpus and the state of its documents, kept in step by runs.

A run takes the documents whose content differs from the state, cleans, cuts and embeds them, and writes its points as
`points/run=N` and then their state as `state/run=N`. Both are only added to. A document's points are those of the run that
its latest state names, so that all its earlier ones go at once when the state of a run is there, higher ordinals of a
document that has become shorter included, and what a run that was killed has left is seen by no one: the next run has the
same number and overwrites it. `settle` writes what counts as one run in another place, when runs have become many.

Runs into one place have to follow each other; two at once would take the same number.

Defined results: a document without chunks (null, blank or too short a text) has a state of 0 chunks and no points; so has
one that is gone, whose hash is null; a document that comes back is ingested again. Identifiers that are null are left out.
Of texts with equal identifiers, that with the least hash counts. A run for which nothing is due writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import corpus as cp
from . import service as sv

STATE = f"{cp.STATE}, run int"
POINTS = "id string, embedding array<float>, text string, section string, citation_prefix string, authority string, category string, jurisdiction string, priority string, year string, title string, document_id string, chunk_idx int, content_hash string, run int"


def state(spark: SparkSession, place: str) -> DataFrame:
    """STATE of each document by its latest run, those that are gone with a null hash."""
    s = cp.held(spark, f"{place}/state", STATE)
    return s.groupBy("id").agg(F.max_by(F.struct(*s.columns[1:]), "run").alias("s")).select("id", "s.*")


def points(spark: SparkSession, place: str) -> DataFrame:
    """POINTS that count. The state is a row for each document, and is broadcast if the planner finds it small."""
    live = state(spark, place).select(F.col("id").alias("document_id"), "run")
    return cp.held(spark, f"{place}/points", POINTS).join(live, ["document_id", "run"], "left_semi")


def _write(rows: DataFrame, place: str, table: str, run: int) -> None:
    rows.drop("run").write.mode("overwrite").parquet(f"{place}/{table}/run={run}")


def run(spark: SparkSession, place: str, manifest: DataFrame, texts: DataFrame, at: str, complete: bool = False, embed: Callable | None = None, method: Column | None = None) -> int | None:
    """Brings place up to date with texts(id, text, content_hash) of the manifest's documents; the run's number, or None.

    at: the time that the state tells. complete: texts are the whole corpus, and documents that it lacks are gone. method:
    the extraction method, of columns of the manifest.
    """
    held = state(spark, place).persist()
    try:
        heads = texts.where("id is not null").select("id", "content_hash").distinct().groupBy("id").agg(F.min("content_hash").alias("content_hash"))
        heads = heads.join(manifest.select("id", "title", F.lower("jurisdiction").alias("jurisdiction"), (F.lit("native") if method is None else method).alias("extraction_method")), "id")
        due = heads.join(held.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
        if complete:
            gone = held.where("content_hash is not null").join(heads, "id", "left_anti")
            due = due.unionByName(gone.select("id", "title", "jurisdiction", "extraction_method").withColumn("content_hash", F.lit(None).cast("string")))
        due = due.persist()
        try:
            if due.isEmpty():
                return None
            number = (held.agg(F.max("run")).first()[0] or 0) + 1
            wanted = texts.join(due.select("id", "content_hash"), ["id", "content_hash"], "left_semi").dropDuplicates(["id", "content_hash"])
            _write(sv.ingest(manifest, wanted, spark.createDataFrame([], cp.STATE), embed), place, "points", number)
            counts = spark.read.parquet(f"{place}/points/run={number}").groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("total_chunks"))
            rows = due.join(counts, "id", "left").select(
                "id", "title", "jurisdiction", "content_hash", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), "extraction_method", F.lit(at).cast("timestamp").alias("last_ingested_at")
            )
            _write(rows, place, "state", number)
            return number
        finally:
            due.unpersist()
    finally:
        held.unpersist()


def run_files(spark: SparkSession, place: str, manifest: DataFrame, folder: str, reader: Callable[[bytes], list[str]], at: str, complete: bool = False, embed: Callable | None = None) -> int | None:
    """A run over the files that the manifest names: found by name, told apart by their bytes, and read only if they are due."""
    files = cp.files(spark, folder)
    named = cp.locate(manifest, files.select("name", "path")).where("path is not null").select(F.col("id"), "path")
    found = named.join(files.select("path", "content_hash"), "path")
    due = found.join(state(spark, place).select("id", "content_hash"), ["id", "content_hash"], "left_anti").select("path").distinct()
    text = cp.document_text(cp.page_text(files.join(due, "path", "left_semi"), reader)).select("path", "text")
    texts = found.join(text, "path", "left").select("id", "text", "content_hash")
    return run(spark, place, manifest, texts, at, complete, embed, cp.extraction_method(F.col("filename"), F.lit(True)))


def settle(spark: SparkSession, place: str, other: str) -> None:
    """What counts, as the only run of another place; documents that are gone are left out."""
    _write(points(spark, place), other, "points", 1)
    _write(state(spark, place).where("content_hash is not null"), other, "state", 1)


def checked(spark: SparkSession, place: str) -> DataFrame:
    """A row of each document that is there: its state, and whether its points are those that the state tells, numbered
    without gaps, of one content and with the identifiers that follow from their numbers."""
    own = tx.uuid5(tx.DNS, F.concat(F.col("document_id"), F.lit("_"), F.col("chunk_idx").cast("string")))
    found = points(spark, place).groupBy(F.col("document_id").alias("id")).agg(
        F.count("*").alias("n"), F.max("chunk_idx").alias("last"), F.countDistinct("chunk_idx").alias("ordinals"), F.min("content_hash").alias("least"), F.max("content_hash").alias("most"),
        F.bool_and((own == F.col("id")) & (F.size("embedding") > 0)).alias("own"),
    )
    s = state(spark, place).where("content_hash is not null").join(found, "id", "left")
    n = F.coalesce("n", F.lit(0))
    whole = (n == F.col("total_chunks")) & ((n == 0) | ((F.col("last") == n - 1) & (F.col("ordinals") == n) & (F.col("least") == F.col("content_hash")) & (F.col("most") == F.col("content_hash")) & F.col("own")))
    return s.select("id", "title", "jurisdiction", "content_hash", "total_chunks", "run", whole.alias("whole"))
