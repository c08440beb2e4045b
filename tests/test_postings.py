"""The stored index: the same hits as by scoring everything, without reading or scoring everything, through changes."""

import random
import re

import pytest
from docweave.operators import index as ix
from docweave.operators import postings as ps
from docweave.operators import rank as rk
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "lang", "text")
SCHEMA = "doc_id bigint, lang string, text string"


def corpus(n, seed=1, vocabulary=400):
    """Frequent and rare words; most documents are short, some long and some without words."""
    r = random.Random(seed)
    word = lambda: f"w{int(vocabulary * r.random() ** 3)}"
    return [(i, r.choice(["en", "en", "fr", "DE"]), " ".join(word() for _ in range(int(200 * r.random() ** 4)))) for i in range(n)]


def asked(spark, n, seed=2, vocabulary=400, words=4):
    r = random.Random(seed)
    rows = [(i, " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(1 + r.randrange(words))), r.choice([None, "en", "FR", "xx"])) for i in range(n)]
    return rk.query_terms(spark.createDataFrame(rows, "query_id int, query string, jurisdiction string"))


def hits(found):
    return sorted((r["query_id"], r["jurisdiction"], r["rank"], r["id"], round(r["score"], 6)) for r in found.collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The index of a corpus with small blocks, and that made anew for comparison."""
    was = ps.BLOCK
    ps.BLOCK = 16
    docs = spark.createDataFrame(corpus(4000), SCHEMA)
    path = f"file://{tmp_path_factory.mktemp('postings')}/index"
    index = ps.create(path, docs, *COLUMNS)
    ps.BLOCK = was
    return index, ix.build(docs, *COLUMNS).tf.cache(), ix.build(docs, *COLUMNS), path


@pytest.mark.parametrize("n,k", [(1000, 10), (200, 3)])
def test_a_thousand_random_questions_have_the_hits_of_a_full_scan(spark, made, n, k):
    index, tf, fresh, _ = made
    terms = asked(spark, n).cache()
    assert (terms.count() > ps.MOST_TERMS) == (n == 1000)  # joined to the scan, and sent to it
    want = hits(rk.bm25(ix.Index(tf, ix.document_frequencies(tf), fresh.stats), terms, k))
    assert len(want) > n
    assert hits(ps.search(index, terms, k, prune=True)) == want
    assert hits(ps.search(index, terms, k, prune=False)) == want


def test_blocks_below_the_kth_score_are_left_out(spark, made):
    terms = rk.query_terms(spark.createDataFrame([(1, "w0 w150", "en"), (2, "w1 w2", "en")], "query_id int, query string, jurisdiction string"))
    heads = ps.asked(made[0], terms)
    every, left = ps.bounds(heads).groupBy("query_id").count().collect(), ps.surviving(made[0], heads, 5).groupBy("query_id").count().collect()
    every, left = ({r["query_id"]: r["count"] for r in x} for x in (every, left))
    assert all(left[q] < every[q] / 2 for q in every), (every, left)


def test_bounds_are_bounds(spark, made):
    terms = asked(spark, 30)
    heads = ps.asked(made[0], terms)
    docs = heads.select("query_id", "jurisdiction", "segment", "block", "idf", "avg_length", F.explode("docs").alias("d"))
    parts = docs.groupBy("query_id", "jurisdiction", "segment", "block", "d.id").agg(F.sum(ps._part(F.col("d.tf"), F.col("d.length"), rk.K1, rk.B)).alias("score"))
    both = parts.join(ps.bounds(heads), ["query_id", "jurisdiction", "segment", "block"])
    assert both.count() > 1000 and both.where("score > bound + 1e-9").count() == 0


def test_a_search_opens_the_files_of_its_terms_only(spark, made):
    index, path = made[0], made[3]
    terms = rk.query_terms(spark.createDataFrame([(1, "w7 w150", "EN")], "query_id int, query string, jurisdiction string"))
    found = ps.search(index, terms, prune=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[term[^\n]*", plan)
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]*", s) and "jurisdiction" in s.split("PartitionFilters")[1] for s in scans)
    assert all(re.search(r"PushedFilters: \[[^\n]*In\(term, \[w150,w7\]\)|Or\(EqualTo\(term", s) for s in scans)
    assert any("docs" not in s.split("ReadSchema")[1] for s in scans)  # bounds are read without the postings
    every = spark.read.parquet(f"{path}/postings").select("_metadata.file_path").distinct().count()
    buckets = [r[0] for r in spark.sql("select pmod(xxhash64(t), 16) from values 'w7', 'w150' as v(t)").collect()]
    opened = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & (F.col("jurisdiction") == "en")).select("_metadata.file_path").distinct().count()
    assert opened < every / 10


def test_the_postings_of_a_frequent_word_lie_in_many_files(spark, tmp_path):
    was, size = ps.BLOCK, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    ps.BLOCK = 16
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(5000).selectExpr("id as doc_id", "'en' as lang", "concat('the ', repeat('x ', cast(id % 50 as int))) as text")
        ps.create(f"file://{tmp_path}/index", docs, *COLUMNS)
    finally:
        ps.BLOCK = was
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", size)
    of_word = spark.read.parquet(f"file://{tmp_path}/index/postings").where("term = 'the'")
    assert of_word.select("_metadata.file_path").distinct().count() >= 2
    assert of_word.selectExpr("max(n)", "sum(n)").first()[1] == 5000 and of_word.selectExpr("max(n)").first()[0] <= 4 * 16 * 2


def changed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_segments_are_like_an_index_made_anew(spark, tmp_path):
    r = random.Random(3)
    now = {row[0]: row for row in corpus(600, 4)}
    path = f"file://{tmp_path}/index"
    index = ps.create(path, changed(spark, list(now.values())), *COLUMNS, buckets=3)
    fresh_ids = iter(range(1000, 2000))
    for step in range(3):
        old = [now.pop(i) for i in r.sample(sorted(now), 120)]
        new = [(i, "fr" if step == 1 else lang, (text or "")[: len(text or "") // 2] + " w3 new") for i, lang, text in old[:80]] + [(next(fresh_ids), "it", "w1 w2 w3"), (next(fresh_ids), None, "w1"), (next(fresh_ids), "en", None)]
        if step == 2:  # a whole jurisdiction goes
            gone = [now.pop(i) for i in [i for i, row in now.items() if row[1] == "DE"]]
            old, new = old + gone, [n for n in new if n[1] != "DE"]
        index = ps.append(path, changed(spark, new), changed(spark, old), *COLUMNS)
        now |= {row[0]: row for row in new}
        docs = changed(spark, list(now.values()))
        fresh, terms = ix.build(docs, *COLUMNS), asked(spark, 40, step)
        want = hits(rk.bm25(fresh, terms, 7))
        assert hits(ps.search(index, terms, 7, prune=True)) == want and len(want) > 40
        count = lambda df: {(x["jurisdiction"], x["term"]): x["df"] for x in df.where("jurisdiction is not null").groupBy("jurisdiction", "term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
        assert count(index.df) == count(fresh.df)
    assert index.segments == (0, 1, 2, 3)
    small = ps.compact(index, f"file://{tmp_path}/compacted")
    assert small.segments == (0,) and small.buckets == 3
    assert hits(ps.search(small, terms, 7)) == want
    assert small.postings.agg(F.sum("n")).first()[0] == fresh.tf.count()


def test_a_segment_that_was_not_finished_is_not_there(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    docs = [(1, "en", "one two"), (2, "en", "two three")]
    ps.create(path, changed(spark, docs), *COLUMNS)
    terms = rk.query_terms(spark.createDataFrame([(1, "two four", None)], "query_id int, query string, jurisdiction string"))
    before = hits(ps.search(ps.load(spark, path), terms))
    real = ps._write

    def failing(rows, where, *args):
        if where.endswith("/stats"):
            raise RuntimeError("stopped here")
        real(rows, where, *args)

    monkeypatch.setattr(ps, "_write", failing)
    with pytest.raises(RuntimeError):
        ps.append(path, changed(spark, [(1, "en", "four four")]), changed(spark, docs[:1]), *COLUMNS)
    monkeypatch.undo()
    assert hits(ps.search(ps.load(spark, path), terms)) == before
    index = ps.append(path, changed(spark, [(1, "en", "four")]), changed(spark, docs[:1]), *COLUMNS)
    assert index.segments == (0, 1)
    assert hits(ps.search(index, terms)) == hits(rk.bm25(ix.build(changed(spark, [(1, "en", "four"), docs[1]]), *COLUMNS), terms))


def test_identifiers_may_be_strings_and_ties_end_at_them(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "en", "same words") for i in range(9)], "doc_id string, lang string, text string")
    index = ps.create(f"file://{tmp_path}/index", docs, *COLUMNS)
    q = rk.query_terms(spark.createDataFrame([(1, "words", None)], "query_id int, query string, jurisdiction string"))
    assert [r["id"] for r in ps.search(index, q, 4, prune=True).orderBy("rank").collect()] == ["d0", "d1", "d2", "d3"]


def test_there_is_no_index(spark, tmp_path):
    assert ps.stored(spark, f"file://{tmp_path}/none") is None


def test_postings_are_shuffled_once_to_be_written(spark, tmp_path, monkeypatch):
    plans, real = {}, ps._write

    def seen(rows, where, *args):
        plans[where.rsplit("/", 1)[1]] = rows._jdf.queryExecution().executedPlan().toString()
        real(rows, where, *args)

    monkeypatch.setattr(ps, "_write", seen)
    ps.create(f"file://{tmp_path}/index", changed(spark, corpus(50)), *COLUMNS)
    assert len(re.findall(r"\bExchange (?:\w+partitioning|SinglePartition)", plans["postings"])) == 1


def test_long_documents_and_blocks_over_batches_are_counted_whole(spark, tmp_path, monkeypatch):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    docs = changed(spark, [*corpus(300, 5), (900, "en", "w1 " * 3000 + "w2"), (901, None, "w1 w2"), (902, "en", None), (903, "en", "")])
    monkeypatch.setattr(ps, "SLICE", 40)
    spark.conf.set(size, "7")
    try:
        index = ps.create(f"file://{tmp_path}/index", docs, *COLUMNS)
    finally:
        spark.conf.set(size, was)
    got = index.postings.select("jurisdiction", F.explode("docs").alias("d"), "term").select("jurisdiction", "d.id", "term", "d.tf", "d.length")
    want = ix.build(docs, *COLUMNS).tf.select("jurisdiction", "id", "term", "tf", "length")
    assert got.count() == want.count() > 1000 and got.exceptAll(want).count() == 0
    assert index.postings.count() == index.postings.select("jurisdiction", "term", "block").distinct().count()


def test_many_questions_meet_the_postings_where_their_documents_are(spark, made, tmp_path):
    index, tf, fresh, _ = made
    terms = asked(spark, 1000).cache()
    assert terms.count() > ps.MOST_TERMS
    found = ps.search(index, terms, 10)
    assert hits(found) == hits(rk.bm25(ix.Index(tf, ix.document_frequencies(tf), fresh.stats), terms, 10))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [jurisdiction" in plan  # the postings by blocks, and no scores by questions
    assert not re.search(r"hashpartitioning\(query_id#\d+, jurisdiction#\d+, segment", found._jdf.queryExecution().executedPlan().toString())

    path = f"file://{tmp_path}/index"
    rows = corpus(300, 6)
    ps.create(path, changed(spark, rows), *COLUMNS)
    new = [(i, "en", "w1 w2 w3") for i, *_ in rows[:40]]
    later = ps.append(path, changed(spark, new), changed(spark, rows[:60]), *COLUMNS)
    want = hits(rk.bm25(ix.build(changed(spark, rows[60:] + new), *COLUMNS), terms, 3))
    assert len(want) > 1000 and hits(ps.search(later, terms, 3)) == want
