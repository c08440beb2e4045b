"""Keeps the passages of a growing corpus up to date, for retrieval.

    spark-submit jobs/ingest_passages.py --documents PATH --passages PATH --checkpoint PATH [--config FILE]

`documents` is a folder of Parquet files (doc_id, text, lang, source) to which files are added: new documents, or further
versions of earlier ones, of which the file modified last counts. A file stream with a checkpoint takes the files that
are new and ends. Of their documents, those whose content is not in the passages already are cleaned and cut, and take the
place of all passages that the document had, so that one that has become shorter leaves nothing behind.

`passages` is partitioned by `part`, ranges of identifiers. A batch reads and rewrites only the parts that its changed
documents fall into, by dynamic partition overwrite; rows carry their document's content hash and are all the state there
is. A run that was stopped halfway leaves whole parts, old or new; the next one gets the same batch from the checkpoint
and does what is missing. Running again without new files changes nothing.

Defined results: a document without words has one passage without words; rows without an identifier are left out and
counted in the log; of equal identifiers in files of one time, the last by file name, then by content hash; files are
never changed in place, as for any file stream.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path[0] = str(Path(__file__).resolve().parent.parent)

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunk, store
from jobs.common import log, main, written

DOCUMENTS = "doc_id bigint, text string, lang string, source string"
PASSAGES = "doc_id bigint, jurisdiction string, title string, content_hash string, passage int, n_words bigint, text string, point_id string, part bigint"


@dataclass(frozen=True)
class Config:
    """Words of a block, blocks of a passage and shared with the next one; identifiers of a part, which is what one task
    holds; files that one batch takes."""

    block_words: int = 40
    passage_blocks: int = 5
    shared_blocks: int = 1
    ids_per_part: int = 5000
    files_per_batch: int = 64


def content_hash() -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("lang", "source", "text"))), 256)


def newest(rows: DataFrame) -> DataFrame:
    """One row for each document, dealt by part."""
    w = Window.partitionBy("part", "doc_id").orderBy(F.desc("at"), F.desc("file"), F.desc("content_hash"))
    return rows.repartition("part").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "at", "file")


def passages(docs: DataFrame, config: Config) -> DataFrame:
    """PASSAGES of docs(doc_id, lang, source, text, content_hash, part)."""
    cleaned = docs.select("doc_id", F.lower("lang").alias("jurisdiction"), F.col("source").alias("title"), "content_hash", "part", tx.clean_text(F.col("text")).alias("text"))
    x = chunk.passages(cleaned, "text", config.block_words, config.passage_blocks, config.shared_blocks)
    x = x.withColumn("point_id", tx.uuid5(tx.DNS, F.concat_ws("_", "doc_id", "passage")))
    return x.select(*(c.split()[0] for c in PASSAGES.split(", ")))


def upsert(batch: DataFrame, number: int, spark: SparkSession, path: str, config: Config) -> None:
    """Puts the changed documents of a batch in the place of their earlier passages.

    What is due is found on identifiers and hashes. Only texts that are due are shuffled, to their parts, and before that by
    their identifiers if those due are too many to be broadcast.
    """
    read = Observation()
    batch = batch.withColumn("content_hash", content_hash()).withColumn("part", F.floor(F.col("doc_id") / config.ids_per_part))
    heads = batch.drop("text", "lang", "source").observe(read, F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nameless"))
    heads = newest(heads.where("doc_id is not null"))
    held = written(spark, path, PASSAGES)
    if held is not None:
        of_batch = [r["part"] for r in batch.select("part").distinct().collect()]
        heads = store.changed(heads, held.where(F.col("part").isin(of_batch) & (F.col("passage") == 0)), "doc_id")
    due = heads.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_due, parts = due.count(), [r["part"] for r in due.select("part").distinct().collect()]
        log.info("passages: batch %d: read %d rows (%d without identifier), %d documents are new or changed", number, read.get["rows"], read.get["nameless"], n_due)
        if not parts:
            return
        wrote = Observation()
        fresh = passages(newest(batch.join(due, ["doc_id", "content_hash"], "left_semi")), config)
        if held is not None:
            fresh = fresh.unionByName(store.without(held.where(F.col("part").isin(parts)), due, "doc_id").repartition("part"))
        rows = fresh.observe(wrote, F.count("*").alias("rows")).sortWithinPartitions("part", "jurisdiction", "doc_id", "passage")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        log.info("passages: batch %d: wrote %d passages in %d parts of %s", number, wrote.get["rows"], len(parts), path)
    finally:
        due.unpersist()


def run(spark: SparkSession, documents: str, passages_path: str, checkpoint: str, config: Config = Config()) -> DataFrame:
    """Takes what is new in documents, and gives the passages as they then stand."""
    log.info("passages: reads new files of %s", documents)
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config.files_per_batch).parquet(documents)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    query = stream.writeStream.foreachBatch(lambda b, n: upsert(b, n, spark, passages_path, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = written(spark, passages_path, PASSAGES)
    return spark.createDataFrame([], PASSAGES) if found is None else found


if __name__ == "__main__":
    main("ingest_passages", __doc__, ["documents", "passages", "checkpoint"], Config, run)
