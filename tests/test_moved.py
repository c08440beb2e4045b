"""What a search without an index shuffles, spills and writes: less than the texts, and in proportion to them."""

import os

import pytest
from docweave.plans import q_rank, registry
from pyspark.sql import functions as F

SF, COPIES = "/root/testdata/sf0.01", 4
#: Searched without an index, each by the same step.
SEARCHES = ["sigmoid_calibration", "eval_metrics", "template_answer", "failure_modes"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sizes(spark, tmp_path_factory):
    """The tables, and with the growing ones repeated under other keys; (folder, bytes of the documents' texts) of both."""
    found = []
    for n in (1, COPIES):
        to = tmp_path_factory.mktemp(f"copies{n}")
        os.symlink(f"{SF}/benchmark.parquet", to / "benchmark.parquet")
        for name, key in (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id")):
            x = spark.read.parquet(f"{SF}/{name}.parquet")
            x.crossJoin(spark.range(n).withColumnRenamed("id", "_n")).withColumn(key, F.col(key) + 100_000 * F.col("_n")).drop("_n").write.parquet(f"file://{to}/{name}.parquet")
        found.append((f"file://{to}", spark.read.parquet(f"file://{to}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]))
    return found


def stages(spark) -> dict:
    """Bytes shuffled, spilled and written by each stage so far."""
    status = spark.sparkContext._jsc.sc().statusStore()
    found = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    rows = [found.apply(i) for i in range(found.length())]
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in rows}


def moved(spark, query: str, sf_dir: str) -> int:
    before = stages(spark)
    assert registry.QUERIES[query](spark, sf_dir).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    return sum(n for s, n in stages(spark).items() if s not in before)


@pytest.mark.parametrize("query", SEARCHES)
def test_a_search_that_comes_first_moves_less_than_the_texts_and_in_proportion(spark, tmp_path, monkeypatch, sizes, query):
    monkeypatch.setattr(q_rank, "shared_dir", lambda _: f"file://{tmp_path}")
    (small, small_bytes), (large, large_bytes) = sizes
    first, then = moved(spark, query, small), moved(spark, query, large)
    assert 0 < first < small_bytes / 2 and then < large_bytes / 2
    assert then < 1.3 * COPIES * first
