"""Retrieval quality, latency and corpus counts as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_gold(candidates: DataFrame, gold: Column, rank: str = "rank") -> DataFrame:
    """(query_id, gold_rank): the best rank of a gold row in each query's list."""
    return candidates.where(gold).groupBy("query_id").agg(F.min(rank).alias("gold_rank"))


def judged(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """candidates(query_id, title, section, ...) with `gold`: whether the expected document's name lies in the title and any
    of the expected sections' in the section, whatever their case. gold(query_id, gold_doc, gold_sections)."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    named = low(F.col("title")).contains(low(F.col("gold_doc")))
    placed = F.exists("gold_sections", lambda g: low(F.col("section")).contains(low(g)))
    hit = F.coalesce(named & placed, F.lit(False))
    return candidates.join(gold, "query_id", "left").withColumn("gold", hit).drop("gold_doc", "gold_sections")


#: Words of an answer that tell a question apart whose premise does not hold.
DENIALS = ("not", "cannot", "prohibit", "can be")


def benchmark(questions: DataFrame, top: DataFrame, rank: str = "rank") -> DataFrame:
    """A row of the published figures' inputs for each question. questions(query_id, exact, negative, answer, latency_ms),
    top(query_id, rank, gold, text): what was answered from.

    A negative question is right if its gold is on top or its answer denies; a citation is if the gold is on top.
    """
    per = top.groupBy("query_id").agg(F.min(F.when(F.col("gold"), F.col(rank))).alias("gold_rank"), (F.count("*") - F.countDistinct(F.coalesce("text", F.lit("")))).alias("duplicates"))
    x = questions.join(per, "query_id", "left")
    said = F.lower(F.coalesce("answer", F.lit("")))
    denied = F.lit(False)
    for w in DENIALS:
        denied = denied | said.contains(w)
    hit = F.col("gold_rank").isNotNull()
    return x.select(
        "query_id", "exact", "negative", "gold_rank", hit.alias("hit"), F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0)).alias("rr"),
        F.when(F.col("negative"), hit | denied).alias("negative_right"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "latency_ms",
    )


def published(rows: DataFrame, *by: str) -> DataFrame:
    """The summary of `benchmark` rows: counts with their shares, as far as there are questions of the kind."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    of = lambda c, kind: F.round(F.avg(F.when(kind, F.col(c).cast("double"))), 6)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("hit").alias("n_hit"), share("hit").alias("recall5"), F.round(F.avg("rr"), 6).alias("mrr"), of("hit", F.col("exact")).alias("exact_recall5"), of("hit", ~F.col("exact")).alias("paraphrased_recall5"),
        F.count_if("negative").alias("n_negative"), of("negative_right", F.col("negative")).alias("negative_correct"), share("hit").alias("citation_accuracy"), F.sum("duplicates").alias("duplicates"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
    )


def evaluated(queries: DataFrame, gold_ranks: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """queries with gold_rank, reciprocal rank and hits at each k, over the whole candidate pool."""
    x = queries.join(gold_ranks, "query_id", "left")
    x = x.withColumn("rr", F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0)))
    for k in ks:
        x = x.withColumn(f"hit{k}", F.coalesce(F.col("gold_rank") <= k, F.lit(False)))
    return x


def rates(ks: tuple[int, ...] = (5, 10, 20)) -> list[Column]:
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return [F.count("*").alias("n"), *(share(f"hit{k}").alias(f"recall{k}") for k in ks), F.round(F.avg("rr"), 6).alias("mrr")]


def failure_mode(exact: Column, dense: Column, sparse: Column, fused: Column, in_top: Column, cited: Column) -> Column:
    """Why a query's gold row is not on top: by which lists had it. Ranks are null where a list did not.

    The order is that in which the classes are published; in it the last two can't be reached, as a row is fused or not."""
    return (
        F.when(in_top, "NONE")
        .when(dense.isNull() & sparse.isNull() & exact, "A. Chunking problem")
        .when(dense.isNull() & sparse.isNull(), "G. Query expansion problem")
        .when(dense.isNull(), "C. Dense retrieval problem")
        .when(sparse.isNull(), "D. BM25 problem")
        .when(fused, "F. CrossEncoder reranking problem")
        .when(~fused, "E. RRF fusion problem")
        .when(~cited, "H. Answer-generation/citation problem")
        .otherwise("B. Metadata problem")
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, percentage)."""
    x = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return x.withColumn("percentage", F.round(100.0 * F.col("n") / total, 6))


def duplicates(rows: DataFrame, group: str, text: str) -> DataFrame:
    """For each group the rows whose text another one has: rows less distinct texts. Null texts count as blank."""
    t = F.coalesce(F.col(text), F.lit(""))
    per_text = rows.groupBy(group, F.md5(t).alias("_t")).agg(F.count("*").alias("_n"))
    return per_text.groupBy(group).agg(F.sum("_n").alias("n"), (F.sum("_n") - F.count("*")).alias("duplicates"))


def latencies(ms: str) -> list[Column]:
    r = lambda c: F.round(c, 6)
    return [F.count("*").alias("n"), r(F.avg(ms)).alias("mean"), r(F.min(ms)).alias("least"), r(F.max(ms)).alias("most")]


def latency(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    return rows.groupBy(*by).agg(*latencies(ms))


def argmin(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The `by` with the lowest mean value; ties go to the first."""
    x = rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"))
    return x.agg(F.min_by(by, F.struct("mean", by)).alias(by), F.min("mean").alias("mean"))
