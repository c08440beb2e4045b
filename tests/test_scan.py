"""BM25 without an index: the hits of a full scan, from one pass over the texts that keeps the asked terms only."""

import os

import pytest
from docweave.operators import index as ix
from docweave.operators import postings as ps
from docweave.operators import rank as rk
from docweave.plans import q_metrics, q_rank, tables
from pyspark.sql import functions as F
from test_postings import COLUMNS, SCHEMA, asked, corpus, hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,k,most", [(300, 10, ps.MOST_TERMS), (300, 10, 5), (0, 3, ps.MOST_TERMS)])
def test_hits_are_those_of_a_full_scan(spark, tmp_path, monkeypatch, n, k, most):
    monkeypatch.setattr(ps, "MOST_TERMS", most)
    docs = spark.createDataFrame([*corpus(800, 7), (900, None, "w1 w2"), (901, "en", None), (902, "en", ""), (903, "fr", "zz")], SCHEMA)
    terms = asked(spark, n) if n else asked(spark, 1).limit(0)
    want = hits(rk.bm25(ix.build(docs, *COLUMNS), terms, k))
    assert (len(want) > n) == (n > 0)
    assert hits(ps.scan(docs, *COLUMNS, terms, f"file://{tmp_path}/kept", k)) == want


def test_other_jurisdictions_are_not_read_and_few_terms_are_kept(spark, tmp_path):
    docs = spark.createDataFrame(corpus(400, 8), SCHEMA)
    terms = rk.query_terms(spark.createDataFrame([(1, "w3 w9", "EN")], "query_id int, query string, jurisdiction string"))
    found = ps.scan(docs, *COLUMNS, terms, f"file://{tmp_path}/kept", 5)
    kept = spark.read.parquet(f"file://{tmp_path}/kept")
    assert kept.count() == docs.where("lang = 'en'").count() and kept.agg(F.max(F.size("codes"))).first()[0] == 2
    assert hits(found) == hits(rk.bm25(ix.build(docs, *COLUMNS), terms, 5))


def test_too_many_terms_or_weights_are_left_to_the_index(spark, tmp_path, monkeypatch):
    docs, terms = spark.createDataFrame(corpus(50), SCHEMA), asked(spark, 20)
    monkeypatch.setattr(ps, "MOST_WEIGHTS", 10)
    assert ps.scan(docs, *COLUMNS, terms, f"file://{tmp_path}/terms") is None
    monkeypatch.setattr(ps, "MOST_WEIGHTS", terms.select("term").distinct().count())
    assert ps.scan(docs, *COLUMNS, terms, f"file://{tmp_path}/weights") is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("query", [q_rank.bm25_two_query_merge, q_rank.sigmoid_calibration, q_metrics.eval_published, q_metrics.eval_metrics, q_metrics.template_answer, q_metrics.failure_modes])
def test_a_query_that_comes_first_writes_no_index(spark, tmp_path, monkeypatch, query):
    for module in (q_rank, tables):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}")
    without = sorted(map(str, query(spark, SF).collect()))
    assert not [d for d in os.listdir(tmp_path / "docweave-index") if d.startswith(ps.FORMAT)]
    q_rank.stored_index(spark, SF)
    assert sorted(map(str, query(spark, SF).collect())) == without
