"""The service's entry points as batch plans: ingest a corpus, retrieve for questions, answer requests, compare.

Every function takes and returns DataFrames over many documents or requests at once; nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as tx
from ..operators import chunk as ck
from ..operators import index as ix
from ..operators import rank as rk
from ..operators import rules as rl
from ..operators import store as st


@dataclass(frozen=True)
class Settings:
    """Sizes of the lists on the way: dense 30 and sparse 20, 25 fused, 5 final, 3 of a title before others."""

    dense: int = 30
    sparse: int = 20
    fused: int = 25
    final: int = 5
    per_title: int = 3
    rerank_chars: int = 750


POINT = ["id", "embedding", "text", "section", "citation_prefix", "authority", "category", "jurisdiction", "priority", "year", "title"]


def ingest(manifest: DataFrame, texts: DataFrame, state: DataFrame, embed: Callable | None = None) -> DataFrame:
    """Points of the documents that are new or changed. texts(id, text, content_hash): the manifest's documents read.

    To store them, use `store.replace_documents` by `document_id`, then rebuild the index of the partitions touched.
    """
    due = st.changed(texts, state).join(manifest, "id")
    cleaned = due.withColumn("text", tx.clean_text(F.col("text")))
    chunks = ck.split_documents(cleaned.withColumnRenamed("id", "document_id"), strategy=F.col("chunk_strategy"))
    point_id = tx.uuid5(tx.DNS, F.concat(F.col("document_id"), F.lit("_"), F.col("chunk_idx").cast("string")))
    x = chunks.withColumn("id", point_id).withColumn("jurisdiction", F.lower("jurisdiction")).withColumn("embedding", models.embed(F.col("text"), embed))
    return x.select(*POINT, "document_id", "chunk_idx", "content_hash")


def ingest_state(points: DataFrame, method: str, at) -> DataFrame:
    """The state rows of the documents in points."""
    return points.groupBy(F.col("document_id").alias("id")).agg(F.first("title").alias("title"), F.first("jurisdiction").alias("jurisdiction"), F.first("content_hash").alias("content_hash"), F.count("*").cast("int").alias("total_chunks"), F.lit(method).alias("extraction_method"), F.lit(at).cast("timestamp").alias("last_ingested_at"))


def build_index(points: DataFrame) -> ix.Index:
    """BM25 statistics over title, prefix, section and text, with citation-aware tokens."""
    body = tx.searchable(F.col("title"), F.col("citation_prefix"), F.col("section"), F.col("text"))
    return ix.build(points.select("id", "jurisdiction", body.alias("body")), "id", "jurisdiction", "body", tokenizer=tx.legal_tokens)


def retrieve(questions: DataFrame, points: DataFrame, index: ix.Index, expansions: DataFrame, s: Settings = Settings(), embed: Callable | None = None, score: Callable | None = None) -> DataFrame:
    """questions(query_id, query, jurisdiction) -> the final candidates of each, with all ranks and scores.

    Sparse hits of the normalised question come before those of the expanded one. Texts are joined after the cut.
    """
    q = questions.select("query_id", tx.normalize_citations(F.col("query")).alias("query"), F.lower("jurisdiction").alias("jurisdiction"))
    expanded = rl.expand(q.select("query_id", "query"), expansions).select("query_id", "expanded").join(q.select("query_id", "jurisdiction"), "query_id")
    vectors = expanded.select("query_id", "jurisdiction", models.embed(F.col("expanded"), embed).alias("vector"))
    dense = rk.dense(points, vectors, s.dense, within="jurisdiction")
    lists = [rk.bm25(index, rk.query_terms(x, text, tx.legal_tokens), s.sparse) for x, text in ((q, "query"), (expanded, "expanded"))]
    fused = rk.fuse(dense, rk.merge_two(*lists), s.fused)
    x = fused.join(points.drop("embedding"), "id").join(q.select("query_id", "query"), "query_id")
    pair = tx.rerank_text(F.col("title"), F.col("citation_prefix"), F.col("section"), F.col("text"), s.rerank_chars)
    x = x.withColumn("rerank_score", F.round(models.cross_encode(F.col("query"), pair, score), 9))
    x = rk.rerank(x, "rerank_score").withColumn("score", tx.sigmoid(F.col("rerank_score")))
    return rk.diversify(x, "title", "rerank_rank", s.per_title, s.final)


def diagnostics(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("query_id").agg(F.count("*").alias("n"), F.count("dense_rank").alias("from_dense"), F.count("bm25_rank").alias("from_sparse"), F.max("score").alias("top_score"), F.countDistinct("title").alias("titles"))


def ask(requests: DataFrame, found: Callable[[DataFrame], DataFrame], outcomes: DataFrame) -> DataFrame:
    """requests(query_id, query, jurisdiction, prior, classification) -> a row each: language, compliance state, gate,
    route (ask, abstain or answer), answer, citations. found: questions to candidates, as `retrieve` with its tables bound.

    Answers are put together from the candidates; a generator would take `context` through `models.complete`.
    """
    names = ["is_sourced_from_india", "is_commercial_use", "is_foreign_entity"]
    given = [F.lit(None).cast("boolean").alias(n) for n in names if n not in requests.columns]
    flow = rl.abs_flow(requests.select("*", *given), outcomes).select("query_id", "triggered", F.col("status").alias("compliance"), "outcome", "next_question")
    q = F.col("query")
    x = requests.select(
        "query_id", "query", "jurisdiction", tx.detect_language(q).alias("language"), rl.tkdl_trigger(q, F.col("classification")).alias("prior_art"),
        rl.question_gate(q, F.col("classification").isNotNull(), F.col("classification")).alias("gate"), rl.in_context(q, F.col("prior"), F.col("jurisdiction")).alias("search"),
    )
    c = found(x.where("gate <> 'ask'").select("query_id", F.col("search").alias("query"), "jurisdiction"))
    one = F.struct("position", "title", "section", "text", "score")
    chunks = c.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    x = x.join(flow, "query_id", "left").join(chunks, "query_id", "left")
    route = F.when(F.col("gate") == "ask", "ask").when(F.col("chunks").isNull(), "abstain").otherwise("answer")
    k = F.col("chunks")
    cites = F.transform(F.slice(k, 1, 3), lambda y: F.struct(y["title"].alias("source"), y["section"].alias("section")))
    return x.withColumn("route", route).select(*x.columns[:-1], "route", F.when(F.col("route") == "answer", rl.template_answer(k)).alias("answer"), rl.context_block(k).alias("context"), F.when(F.col("route") == "answer", cites).alias("citations"))


def compare(requests: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each request under both jurisdictions in one plan, with the sources that both cite."""
    both = F.explode(F.array(F.lit("national"), F.lit("international"))).alias("jurisdiction")
    x = requests.drop("jurisdiction").select("*", both).withColumn("query_id", F.concat(F.col("query_id").cast("string"), F.lit("_"), F.substring("jurisdiction", 1, 3)))
    a = answer(x).withColumn("request", F.substring_index("query_id", "_", 1))
    names = F.transform(F.coalesce("citations", F.array()), lambda c: tx.canonical_source(c["source"]))
    a = a.withColumn("names", F.array_distinct(names))
    n, i = (a.where(f"jurisdiction = '{j}'").select("request", F.col("answer").alias(f"{j}_answer"), F.col("names").alias(f"{j}_names")) for j in ("national", "international"))
    x = n.join(i, "request")
    return x.withColumn("shared", F.array_sort(F.array_intersect("national_names", "international_names"))).withColumn("isolated", F.size("shared") == 0)
