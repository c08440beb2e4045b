"""Approximate dense search: an inverted file of vectors with product-quantised codes, and exact scores for a few of them.

`fit` finds, on a bounded sample, the centres of LISTS and, for parts of what is left of a vector less its centre, the
codes that stand for it. `build` gives each vector its list and its codes, a byte for each part, and writes codes and
vectors apart, partitioned by list. `search` reads the codes of the lists nearest to the questions, an eighth of what the
vectors take, puts vectors together from them, ranks by those, and scores the `refine` * k best of each question exactly,
for which only their vectors are read of each list. `rank.dense` stays the exact way.

How many lists have to be probed depends on the vectors: few if they lie in clusters, most if they are spread evenly, as
random ones are, where the codes are what saves reading. Recall is to be measured against `rank.dense` (`recall`).

Defined results: vectors of another length than the sample's most frequent one and missing ones are in no list and are
never found; ties end at the identifier; an empty table has an index in which nothing is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rank as rk


@dataclass(frozen=True)
class Params:
    """Rows of the sample; lists, and how many are probed for a question; parts of a vector and codes of a part; k times
    `refine` vectors are scored exactly; rounds of the fit."""

    sample: int = 20_000
    lists: int = 32
    probes: int = 24
    parts: int = 32
    codes: int = 256
    refine: int = 3
    rounds: int = 12


@dataclass(frozen=True)
class Model:
    centres: np.ndarray  # lists x length
    books: np.ndarray  # parts x codes x length of a part

    @property
    def length(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes of each row."""
        near = _nearest(x, self.centres)
        rest = (x - self.centres[near]).reshape(len(x), len(self.books), -1)
        return near, np.column_stack([_nearest(rest[:, j], b) for j, b in enumerate(self.books)]).astype(np.uint8)

    def decode(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[near] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin((centres**2).sum(axis=1) - 2 * x[i : i + 4096] @ centres.T, axis=1)
    return out


def _centres(x: np.ndarray, n: int, rounds: int, seed: int = 1) -> np.ndarray:
    """Centres of at most n groups, by Lloyd's rounds from rows drawn at random; a group that is empty keeps its centre."""
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n_at = np.bincount(at, minlength=len(c))[:, None]
        c = np.where(n_at > 0, sums / np.maximum(n_at, 1), c)
    return c


def fit(points: DataFrame, params: Params = Params()) -> Model | None:
    """The model of points(id, embedding), on the `sample` rows whose identifiers' hashes come first; None without any."""
    held = points.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(params.sample).select("embedding").toArrow().column(0).to_pylist()
    lengths = np.bincount([len(v) for v in held]) if held else np.zeros(0)
    if not len(lengths) or not lengths[1:].any():
        return None
    length = int(lengths.argmax())
    x = np.array([v for v in held if len(v) == length], np.float64)
    centres = _centres(x, params.lists, params.rounds)
    parts = max(p for p in range(1, min(params.parts, length) + 1) if length % p == 0)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
    return Model(centres, np.array([_centres(rest[:, j], params.codes, params.rounds) for j in range(parts)]))


_CODED = "struct<list:int,code:binary>"


def _encoder(model: Model) -> Column:
    def encode(vectors: pa.Array) -> pa.Array:
        rows = vectors.to_pylist()
        fits = [i for i, v in enumerate(rows) if v is not None and len(v) == model.length]
        out: list[dict | None] = [None] * len(rows)
        if fits:
            near, codes = model.encode(np.array([rows[i] for i in fits], np.float64))
            for i, n, c in zip(fits, near.tolist(), codes, strict=True):
                out[i] = {"list": n, "code": c.tobytes()}
        return pa.array(out, pa.struct([("list", pa.int32()), ("code", pa.binary())]))

    return F.arrow_udf(encode, _CODED)("embedding")


def _decoder(model: Model) -> Column:
    def decode(lists: pa.Array, codes: pa.Array) -> pa.Array:
        flat = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), len(model.books))
        x = model.decode(lists.to_numpy(zero_copy_only=False), flat) if len(codes) else np.zeros((0, model.length))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * model.length), pa.array(x.ravel()))

    return F.arrow_udf(decode, "array<double>")("list", "code")


@dataclass(frozen=True)
class Index:
    model: Model | None
    codes: DataFrame  # id, code, list
    vectors: DataFrame  # id, embedding, list


def build(points: DataFrame, path: str, params: Params = Params()) -> Index:
    """Writes the index of points(id, embedding): codes, vectors and, last, the model."""
    spark = points.sparkSession
    model = fit(points, params)
    if model is not None:
        coded = points.select("id", "embedding", _encoder(model).alias("c")).where("c is not null").select("id", "embedding", "c.code", "c.list")
        coded.repartition("list").sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        rows.select("id", "code", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    arrays = [] if model is None else [("centres", list(model.centres.shape), model.centres.ravel().tolist()), ("books", list(model.books.shape), model.books.ravel().tolist())]
    spark.createDataFrame(arrays, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """The model, some 100 kB, is on the driver and goes to the tasks."""
    arrays = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/model").collect()}
    if not arrays:
        none = spark.createDataFrame([], "id bigint, code binary, embedding array<float>, list int")
        return Index(None, none.select("id", "code", "list"), none.select("id", "embedding", "list"))
    return Index(Model(arrays["centres"], arrays["books"]), spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/rows").select("id", "embedding", "list"))


def candidates(index: Index, queries: DataFrame, k: int = 30, params: Params = Params()) -> DataFrame:
    """(query_id, id, list): what is scored exactly. Only lists that some question probes are read, and only codes."""
    model = index.model
    if model is None:
        return queries.select("query_id").limit(0).crossJoin(index.codes.select("id", "list"))

    def nearest(vectors: pa.Array) -> pa.Array:
        lists = [np.argsort(((model.centres - np.array(v)) ** 2).sum(axis=1))[: params.probes].tolist() if v is not None and len(v) == model.length else [] for v in vectors.to_pylist()]
        return pa.array(lists, pa.list_(pa.int32()))

    asked = queries.select(F.explode(F.arrow_udf(nearest, "array<int>")("vector")).alias("list")).distinct()
    probed = [r["list"] for r in asked.collect()]
    codes = index.codes.where(F.col("list").isin(probed))
    found = rk.dense(codes.select("id", _decoder(model).alias("embedding")), queries, params.refine * k)
    return found.select("query_id", "id").join(codes.select("id", "list"), "id").select("query_id", "id", "list")


def search(index: Index, queries: DataFrame, k: int = 30, params: Params = Params()) -> DataFrame:
    """(query_id, id, score, rank) as `rank.dense` has them, of the candidates."""
    c = candidates(index, queries, k, params).join(queries.select("query_id", "vector"), "query_id")
    both = c.join(index.vectors, ["list", "id"])
    products = F.zip_with("vector", "embedding", lambda a, b: a.cast("double") * b.cast("double"))
    score = F.round(F.aggregate(products, F.lit(0.0), lambda s, p: s + p), 9)
    return rk.top(both.select("query_id", "id", score.alias("score")), k, "score", "rank", "query_id")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact list that was found."""
    hits = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
