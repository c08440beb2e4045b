"""The corpus manifest, its files, their pages, and which of them have to be read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed
from ..operators import contain

MANIFEST_COLUMNS = "id title authority category jurisdiction priority document_type year filename chunk_strategy citation_prefix update_frequency official_url".split()
MANIFEST = StructType([StructField(c, StringType()) for c in MANIFEST_COLUMNS])
STATE = "id string, title string, jurisdiction string, content_hash string, total_chunks int, extraction_method string, last_ingested_at timestamp"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest CSV: all strings, trimmed, missing values blank. A byte-order mark before the header is skipped, as
    columns are taken by position."""
    raw = spark.read.schema(MANIFEST).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in MANIFEST_COLUMNS))


def manifest_summary(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("total"), F.count_if(F.lower("jurisdiction") == "national").alias("national"), F.count_if(F.lower("jurisdiction") == "international").alias("international"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their bytes and hash; nothing is read before a column asks for it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content", F.sha2("content", 256).alias("content_hash"))


def held(spark: SparkSession, path: str, schema: str, form: str = "parquet", **options) -> DataFrame:
    """The table at path; an empty one before anything was written there."""
    try:
        return spark.read.schema(schema).options(**options).format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The ingest state; an empty table before the first run."""
    return held(spark, path, STATE)


def locate(wanted: DataFrame, found: DataFrame, name: str = "filename") -> DataFrame:
    """wanted with the path of the file it names: equal, equal but for case, or either containing the other once
    separators are left out; the first of these. Names are met by equality and by their grams, never pair by pair."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\s_.,()-]", "")
    f = found.groupBy("name").agg(F.min("path").alias("path"))
    a, b = wanted.select(F.col(name).alias("w")).distinct(), f.select(F.col("name").alias("f"))
    same = a.join(b, F.lower("w") == F.lower("f")).select("w", "f", F.when(F.col("w") == F.col("f"), 1).otherwise(2).alias("rank"))
    near = contain.either(a.withColumn("text", plain("w")), b.withColumn("text", plain("f")), "w", "f")
    near = near.select(F.col("a").alias("w"), F.col("b").alias("f"), F.lit(3).alias("rank"))
    best = same.unionByName(near).groupBy("w").agg(F.min(F.struct("rank", "f")).alias("best"))
    best = best.join(f, F.col("best.f") == F.col("name")).select(F.col("w").alias(name), "path")
    return wanted.join(best, name, "left")


#: Ranges of a key that are numbered apart.
RANGES = 200


def paged(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """rows with their page and place on it, both from 0, in order of key, a number, within each group.

    A group may be most of the table, so that its rows are never numbered in one task: they are numbered within ranges of
    the key, and moved on by the rows of the group in the ranges before. The driver gets the ranges' bounds.
    """
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    bounds = rows.agg(F.percentile_approx(key, shares, F.lit(100 * RANGES))).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    dealt = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(key))))
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), before.alias("_before"))
    n = F.row_number().over(Window.partitionBy(group, "_range").orderBy(key)) - 1
    x = dealt.withColumn("_n", n).join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    at = F.col("_n") + F.col("_before")
    return x.select(*rows.columns, F.floor(at / size).alias("page"), (at % size).alias("place"))


def text_layer(pages: DataFrame, document: str, page: str, chars: str, sample: int = 5, mean: int = 50, total: int = 100) -> DataFrame:
    """Whether the first pages of each document hold enough text of their own."""
    x = pages.where(F.col(page) < sample).groupBy(document).agg(F.avg(chars).alias("_mean"), F.sum(chars).alias("_total"))
    return x.select(document, ((F.col("_mean") >= mean) | (F.col("_total") >= total)).alias("has_text"))


def in_ranges(pages: DataFrame, ranges: DataFrame, page: str = "page") -> DataFrame:
    """pages within any of the half-open ranges(start, stop, part); the planner broadcasts these as they are few."""
    return pages.join(ranges, (F.col(page) >= F.col("start")) & (F.col(page) < F.col("stop")))


def drug_act_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.DRUG_ACT_PAGES, "start int, stop int, part string")


def extraction_method(name, has_text):
    """Which way a file's text is read."""
    return F.when(F.lower(name).contains("2016drugsandcosmeticsact"), "targeted_native").when(has_text, "native").otherwise("OCR")


def page_text(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) through a reader of one file's bytes (a PDF or OCR library). A failing file gives one page
    that says so, as the rest of a corpus must not stop for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts = reader(content)
                except Exception as e:  # noqa: BLE001
                    texts = [f"[unreadable: {e}]"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], ["path", "page", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string")


def document_text(pages: DataFrame, document: str = "path") -> DataFrame:
    """Each document's pages that are not blank, in order, parted by blank lines."""
    x = pages.where(F.trim("text") != "").groupBy(document).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return x.select(document, F.array_join(F.transform("p", lambda y: y["text"]), "\n\n").alias("text"))
