import numpy as np
import pytest
from docweave.operators import ann as an
from docweave.operators import rank as rk
from pyspark.sql import functions as F


def points(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(extra), "id bigint, embedding array<float>").repartition(3)


def asked(p, every):
    return p.where(f"id % {every} = 0 and size(embedding) > 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_against_brute_force_while_few_vectors_are_scored(spark, tmp_path, clustered):
    r = np.random.default_rng(1)
    x = unit(r.normal(size=(1500, 32)) * (0.2 if clustered else 1) + (r.normal(size=(20, 32))[r.integers(0, 20, 1500)] if clustered else 0))
    p = points(spark, x, [(5000, None), (5001, [1.0, 2.0])])
    params = an.Params(lists=20, probes=5 if clustered else 16, parts=16)
    index = an.build(p, f"file://{tmp_path}/index", params)
    assert index.codes.count() == index.vectors.count() == 1500  # every row, not the sample
    q = asked(p, 50)
    found = an.search(index, q, 20, params)
    true = {i: set(np.lexsort((np.arange(1500), -np.round(x.astype(np.float32).astype(float) @ x[i].astype(np.float32).astype(float), 9)))[:20].tolist()) for i in range(0, 1500, 50)}
    got = {}
    for row in found.collect():
        got.setdefault(row["query_id"], {})[row["id"]] = (row["rank"], row["score"])
        assert abs(row["score"] - x[row["query_id"]] @ x[row["id"]]) < 1e-5
    assert np.mean([len(true[i] & set(got[i])) / 20 for i in true]) >= 0.9
    assert all(sorted(v[0] for v in got[i].values()) == list(range(1, 21)) for i in true)
    measured = {row["query_id"]: row["recall"] for row in an.recall(found, rk.dense(p, q, 20)).collect()}
    assert measured == {i: round(len(true[i] & set(got[i])) / 20, 6) for i in true}
    scored = an.candidates(index, q, 20, params)
    assert scored.groupBy("query_id").count().agg(F.max("count")).first()[0] < 1500 / 5
    if clustered:
        assert an.candidates(index, q.limit(1), 20, params).select("list").distinct().count() <= 5


def test_the_fit_is_bounded_and_the_same_again(spark):
    x = unit(np.random.default_rng(2).normal(size=(300, 8)))
    params = an.Params(sample=100, lists=4, parts=8, codes=16)
    a, b = (an.fit(points(spark, x).repartition(n), params) for n in (2, 5))
    assert (a.centres == b.centres).all() and (a.books == b.books).all()
    assert a.centres.shape == (4, 8) and a.books.shape == (8, 16, 1)
    near, codes = a.encode(x)
    assert np.linalg.norm(a.decode(near, codes) - x, axis=1).mean() < 0.3


def test_few_and_no_vectors(spark, tmp_path):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    none = an.build(spark.createDataFrame([], "id bigint, embedding array<float>"), f"file://{tmp_path}/none")
    assert none.model is None and an.search(none, q, 3).count() == 0
    few = an.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id bigint, embedding array<float>"), f"file://{tmp_path}/few")
    assert [(r["id"], r["rank"]) for r in an.search(few, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
