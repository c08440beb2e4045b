"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents.

In every stage: other columns of docs, whatever their names, are left out; an empty table gives an empty one of the same
columns; a null identifier, language, source or length is kept as it is; whole texts are read, however long, one of them
in one task at a time. What null and empty texts, repeated rows and ties give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, jaccard_join, line_dedup, packing
from docweave.llm.common import materialize, release, small
from docweave.llm.quality_ledger import DEFAULT_POLICY, POLICIES, ledger, verdict

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects every document that fails a rule of the default policy.

    Null and empty texts have no words and go, as any text of fewer than ten does; repeated rows are judged alike, row by row;
    at a limit the rule's own comparison decides, so that no ties are left open.
    """
    judged = ledger(docs.select(*COLUMNS))
    return judged.where(verdict(judged["_ledger"]["bits"], POLICIES[DEFAULT_POLICY])).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source from its texts; every document stays.

    Null texts stay null, texts of boilerplate only become empty lines or empty; rows without a source are a source of
    their own; repeated rows count as pages of their own; a line on exactly the limiting share of pages stays.
    """
    cut = line_dedup.drop_lines(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("_lines_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the row with the smallest identifier, one without an identifier only if none has one.

    What goes, the smaller part, is joined rather than what stays, so that texts are shuffled only if that is large.
    Rows that share an identifier or have none are told apart by all their columns, and equal ones become one; rows
    without words and without an identifier stay. Null and empty texts are near to nothing and stay. Ties between
    rows of one identifier go by a hash of their columns.
    """
    docs = docs.select(*COLUMNS)
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null")
    if unclear.limit(1).count():
        return _near_duplicates_by_row(docs)
    gone = jaccard_join.join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(small(materialize(gone, "gone")), F.col("doc_id") == F.col("_gone"), "left_anti")


def _near_duplicates_by_row(docs: DataFrame) -> DataFrame:
    """The same where identifiers do not name rows: by a hash of all columns."""
    docs = docs.withColumn("_row", F.xxhash64(*COLUMNS))
    joined = jaccard_join.join(docs, key="_row").groupBy(F.col("doc_id").alias("_row"), "component_id").agg(F.count("*").alias("_n"), F.max("n_shingles").alias("_words"))
    named = materialize(joined.join(docs.select("_row", "doc_id").distinct(), "_row"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    first = materialize(named.groupBy("component_id").agg(first.alias("f")).select("component_id", F.col("f")["_row"].alias("_first")), "first")
    gone = materialize(named.join(small(first), "component_id").where("_row <> _first").select("_row"), "gone")
    kept = docs.join(small(gone), "_row", "left_anti")
    twice = materialize(named.where("_n > 1 and (doc_id is not null or _words > 0)").select("_row"), "twice")
    release(named, first)
    if twice.limit(1).count():
        kept = kept.join(small(twice), "_row", "left_anti").unionByName(kept.join(small(twice), "_row", "left_semi").distinct())
    return kept.select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; long benchmark passages in others are cut out.

    Null and empty texts have no hits and stay, and so does everything if the benchmark is empty; repeated rows are judged
    alike; a document exactly at the share of hit words goes.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cut = decontaminate.clean(docs.select(*COLUMNS), items)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens.

    A null or empty text is the end token alone; repeated rows are packed each for itself; between documents of equal cost
    the order of the packing operator decides.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("packing", pack),
]

#: Packing depends on the vocabulary and on pieces cut freely, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if held is not None:
            release(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
