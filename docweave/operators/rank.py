"""Ranking: BM25, exact dense search, fusion, reranking, diversity, neighbours.

Ties end at the identifier and scores are rounded to 9 decimals before ordering, so that ranks don't depend on the
order of float sums. Inputs of all functions may hold many queries; `query_id` is the partition of every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .index import Index, idf

K1, B = 1.5, 0.75
RRF_K = 60


def query_terms(queries: DataFrame, text: str = "query", tokenizer=words) -> DataFrame:
    """(query_id, jurisdiction, term): the distinct terms; jurisdiction null searches every partition."""
    return queries.select("query_id", F.lower("jurisdiction").alias("q_jurisdiction"), F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("term"))


def top(scored: DataFrame, k: int, score: str, rank: str, *by: str) -> DataFrame:
    """The k best rows of each group: by score, then id. The ranking window is cut early, before the sort is complete."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), "id")
    return scored.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


def bm25(index: Index, terms: DataFrame, k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, jurisdiction, id, score, rank). Only documents that share a term with the query are touched.

    Statistics are a row per partition, and the query's terms are few by nature; the planner broadcasts either if small.
    """
    hits = index.tf.join(terms, "term").where(F.col("q_jurisdiction").isNull() | (F.col("q_jurisdiction") == F.col("jurisdiction")))
    x = hits.join(index.df.join(terms.select("term"), "term", "left_semi"), ["jurisdiction", "term"]).join(index.stats, "jurisdiction")
    norm = F.when(F.col("avg_length") > 0, F.col("length") / F.col("avg_length")).otherwise(0.0)
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * norm))
    scored = x.groupBy("query_id", "jurisdiction", "id").agg(F.round(F.sum(part), 9).alias("score"))
    return top(scored.where("score > 0"), k, "score", "rank", "query_id", "jurisdiction")


def merge_two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of the first list keep their ranks; those found only by the second come after them, in its order."""
    by = ["query_id", "jurisdiction"]
    new = second.join(first.select(*by, "id"), [*by, "id"], "left_anti")
    n1 = first.groupBy(*by).agg(F.count("*").alias("n1"))
    w = Window.partitionBy(*by).orderBy("rank")
    new = new.withColumn("r", F.row_number().over(w)).join(n1, by, "left")
    new = new.select(*by, "id", "score", (F.coalesce("n1", F.lit(0)) + F.col("r")).cast("bigint").alias("rank"))
    return first.select(*by, "id", "score", "rank").unionByName(new)


def dense(points: DataFrame, queries: DataFrame, k: int = 30, where: Column | None = None, within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine of unit vectors, exactly. queries(query_id, vector).

    A filter comes before the ranking, so that it does not shrink the list; within: a column of both that has to be
    equal. Questions go to the points in blocks of QUERY_BLOCK; each batch of points gives, as one matrix product, the
    scores of a block, and only those go on that are among the k best of the task so far. Points and questions without a
    vector are left out.
    """
    p = points if where is None else points.where(where)
    of = F.col(within).cast("string") if within else F.lit("")
    p = p.where("embedding is not null").select("id", "embedding", of.alias("part"))
    q = queries.where("vector is not null").select("query_id", "vector", of.alias("part"))
    blocks = -(-q.count() // QUERY_BLOCK) or 1
    context, scored = p.sparkSession.sparkContext, None
    types = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {p.schema['id'].dataType.simpleString()}, score double"
    for n in range(blocks):
        block = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        rows = block.toArrow()
        found = p.mapInArrow(_nearest(context.broadcast(rows), k), types)
        scored = found if scored is None else scored.unionByName(found)
    return top(scored, k, "score", "rank", "query_id")


#: So many question vectors, a few kilobytes each, are on the driver and sent to the executors at once.
QUERY_BLOCK = 4096
#: Questions whose scores for one batch of points are in memory at once.
_SLICE = 256


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the given width as rows, and which they are."""
    fits = np.flatnonzero(pc.equal(pc.list_value_length(vectors), width).to_numpy(zero_copy_only=False))
    return vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width), fits


def _nearest(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value.combine_chunks()
        widths = pc.unique(pc.list_value_length(asked["vector"])).to_pylist() if len(asked) else []
        blocks = []
        for w in widths:
            m, at = _matrix(asked["vector"].combine_chunks(), w)
            parts = np.array(asked["part"].to_pylist(), object)[at]
            blocks += [(w, m[i : i + _SLICE], parts[i : i + _SLICE], at[i : i + _SLICE], np.full((k, len(m[i : i + _SLICE])), -np.inf)) for i in range(0, len(m), _SLICE)]
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("id")))
            for w, m, parts, at, best in blocks:
                x, rows = _matrix(batch.column("embedding"), w)
                if not len(x):
                    continue
                scores = np.nan_to_num(np.round(x @ m.T, 9), nan=-np.inf)
                here = np.array(batch.column("part").to_pylist(), object)[rows]
                scores[here[:, None] != parts[None, :]] = -np.inf
                both = np.concatenate([best, scores])
                best[:] = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
                point, query = np.nonzero((scores >= best.min(axis=0)) & (scores > -np.inf))
                if len(point):
                    values = scores[point, query]
                    # of many points with a question's k-th score, the first k of the batch are enough
                    order = np.lexsort((point, -values, query))
                    nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                    order = order[nth < k]
                    yield pa.RecordBatch.from_arrays([asked["query_id"].combine_chunks().take(pa.array(at[query[order]])), batch.column("id").take(pa.array(rows[point[order]])), pa.array(values[order])], ["query_id", "id", "score"])

    return run


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 25, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two lists: (query_id, id, dense_rank, bm25_rank, ..., rrf_score, rrf_rank)."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    both = d.join(s, ["query_id", "id"], "full").withColumn("rrf_score", F.round(part("dense_rank") + part("bm25_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "id")
    return both.withColumn("rrf_rank", F.row_number().over(w).cast("bigint")).where(F.col("rrf_rank") <= k)


def rerank(candidates: DataFrame, score: str, rank: str = "rerank_rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return candidates.withColumn(rank, F.row_number().over(w).cast("bigint"))


def diversify(ranked: DataFrame, group: str, rank: str, per_group: int = 3, k: int = 5) -> DataFrame:
    """k rows with at most per_group of a group before any further ones. A group's first ones always get in and the
    rest fill up in order of rank, so that this is one ordering rather than a walk."""
    nth = F.row_number().over(Window.partitionBy("query_id", group).orderBy(rank))
    x = ranked.withColumn("nth", nth)
    w = Window.partitionBy("query_id").orderBy(F.col("nth") > per_group, rank)
    return x.withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= k)


def neighbours(rows: DataFrame, group: str, ordinal: str, hit: Column, reach: int = 2) -> DataFrame:
    """Rows within `reach` of each group's first row that satisfies `hit`."""
    first = rows.where(hit).groupBy(group).agg(F.min(ordinal).alias("target"))
    return rows.join(first, group).where(F.abs(F.col(ordinal) - F.col("target")) <= reach)


def entry_rank(ranked: DataFrame, wanted: Column, pools: list[int]) -> DataFrame:
    """For each pool size, the best rank of a wanted row within the pool; the ranking is of all rows."""
    sizes = F.explode(F.array(*map(F.lit, pools))).alias("pool")
    found = ranked.where(wanted).select("rank", sizes).where("rank <= pool")
    all_pools = ranked.limit(1).select(sizes)
    return all_pools.join(found.groupBy("pool").agg(F.min("rank").alias("entry")), "pool", "left")
