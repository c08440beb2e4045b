import math
import random
from collections import Counter

from docweave.operators import index as ix
from docweave.operators import postings as ps
from docweave.operators import rank as rk
from pyspark.sql import functions as F


def corpus(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["en", "fr"]), " ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(r.randrange(0, 30)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id int, lang string, text string")


def loop_bm25(rows, query, k=1000):
    out = {}
    for lang in {r[1] for r in rows}:
        docs = {i: t.split() for i, lg, t in rows if lg == lang}
        n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
        df = Counter(w for d in docs.values() for w in set(d))
        for i, d in docs.items():
            tf = Counter(d)
            s = sum(max(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)), 0.001) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in set(query.split()) if tf[w])
            if s > 0:
                out[lang, i] = s
    return out


def test_bm25_against_a_loop_and_after_reload(spark, tmp_path):
    rows, docs = corpus(spark)
    q = spark.createDataFrame([(1, "aa cc zz aa", None), (2, "bb", "EN")], "query_id int, query string, jurisdiction string")
    terms = rk.query_terms(q)
    fresh = ix.build(docs, "doc_id", "lang", "text")
    kept = ps.create(f"file://{tmp_path}/index", docs, "doc_id", "lang", "text")
    for found in (rk.bm25(fresh, terms, 1000), ps.search(kept, terms, 1000), rk.bm25(ix.build(docs, "doc_id", "lang", "text", terms.select("term")), terms, 1000)):
        got = found.collect()
        one = {(r["jurisdiction"], r["id"]): r["score"] for r in got if r["query_id"] == 1}
        want = loop_bm25(rows, "aa cc zz aa")
        assert one.keys() == want.keys() and all(abs(one[k] - want[k]) < 1e-6 for k in want)
        assert {r["jurisdiction"] for r in got if r["query_id"] == 2} == {"en"}


def test_bm25_cuts_at_k_with_ties_by_id(spark):
    docs = spark.createDataFrame([(i, "en", "same words") for i in range(9)], "doc_id int, lang string, text string")
    q = spark.createDataFrame([(1, "words", None)], "query_id int, query string, jurisdiction string")
    got = rk.bm25(ix.build(docs, "doc_id", "lang", "text"), rk.query_terms(q), 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3]


def ranked(spark, ids):
    return spark.createDataFrame([(1, i, n, 1.0 / n) for n, i in enumerate(ids, 1)], "query_id int, id int, rank int, score double")


def test_fusion_is_symmetric_in_its_scores(spark):
    a, b = ranked(spark, [1, 2, 3, 4]), ranked(spark, [3, 9, 1])
    x = {r["id"]: r["rrf_score"] for r in rk.fuse(a, b).collect()}
    y = {r["id"]: r["rrf_score"] for r in rk.fuse(b, a).collect()}
    assert x == y and abs(x[1] - (1 / 61 + 1 / 63)) < 1e-9 and set(x) == {1, 2, 3, 4, 9}


def walk(groups, per, k):
    kept, skipped, seen = [], [], Counter()
    for i, g in enumerate(groups):
        if len(kept) < k and seen[g] < per:
            kept.append(i)
            seen[g] += 1
        else:
            skipped.append(i)
    return (kept + skipped)[:k]


def test_diversity_equals_the_walk(spark):
    r = random.Random(5)
    cases = [[r.choice("abc") for _ in range(r.randrange(1, 14))] for _ in range(60)]
    rows = [(q, i, g, i + 1) for q, c in enumerate(cases) for i, g in enumerate(c)]
    x = rk.diversify(spark.createDataFrame(rows, "query_id int, id int, g string, rank int"), "g", "rank").collect()
    got = {q: [y["id"] for y in sorted((z for z in x if z["query_id"] == q), key=lambda z: z["position"])] for q in range(len(cases))}
    assert all(got[q] == walk(c, 3, 5) for q, c in enumerate(cases))


def test_filter_comes_before_the_dense_cut(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "id int, embedding array<float>, label int")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    assert [r["id"] for r in rk.dense(points, q, 3, F.col("label") == 0).orderBy("rank").collect()] == [18, 16, 14]


def test_two_lists_merge(spark):
    by = lambda ids: ranked(spark, ids).withColumn("jurisdiction", F.lit("en"))
    got = rk.merge_two(by([5, 6]), by([6, 7, 5, 8])).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(5, 1), (6, 2), (7, 3), (8, 4)]


def test_dense_blocks_against_a_loop(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.integers(-3, 4, 8)], "ab"[i % 2]) for i in range(300)]
    odd = [(900, None, "a"), (901, [1.0, 2.0], "a"), (902, [0.0] * 8, None)]
    points = spark.createDataFrame(vectors + odd, "id int, embedding array<double>, side string").repartition(5)
    asked = spark.createDataFrame([(i, v, s) for i, v, s in vectors[:40]] + [(77, None, "a")], "query_id int, vector array<double>, side string")
    for size in (7, 4096):
        monkeypatch.setattr(rk, "QUERY_BLOCK", size)
        for within in (None, "side"):
            got = {(x["query_id"], x["rank"]): x["id"] for x in rk.dense(points, asked, 6, within=within).collect()}
            want = {}
            for q, v, side in vectors[:40]:
                scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w, s in vectors + odd[2:] if within is None or s == side]
                want |= {(q, n): i for n, (_, i) in enumerate(sorted(scored)[:6], 1)}
            assert got == want


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id int, lang string, text string")
    made = ix.build(empty, "doc_id", "lang", "text")
    stored = ps.create(f"file://{tmp_path}/none", empty, "doc_id", "lang", "text")
    q = spark.createDataFrame([(1, "word", None)], "query_id int, query string, jurisdiction string")
    assert rk.bm25(made, rk.query_terms(q)).count() == ps.search(stored, rk.query_terms(q)).count() == stored.postings.count() == 0
    blank = spark.createDataFrame([(1, "en", None), (2, "en", " "), (3, "en", "two two one")], "doc_id int, lang string, text string")
    assert sorted((r["id"], r["term"], r["tf"]) for r in ix.build(blank, "doc_id", "lang", "text").tf.collect()) == [(3, "one", 1), (3, "two", 2)]
