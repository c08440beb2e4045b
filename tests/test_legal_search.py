"""Search by citation-aware tokens: texts are read and cut once, and those without citations are passed over."""

import re

from docweave.functions import text as tx
from docweave.operators import index as ix
from docweave.operators import rank as rk
from pyspark.sql import functions as F

TEXTS = [
    "Section 3(p) and 2(1)(ja)", "12 (a) b", "ART. 6a, article 27", "art.6", "art 6", "rule 158 b", "33-eec", "5 - x", "7_y", "1 2", "a 1", "3", "(a)", "part 9 of", "no digits at all", "9(", "9 ( b )", "12\n(c)", "é 3(é)", "٣(a)", "", None,
]


def test_signs_leave_no_citation_out(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    cases = [(tx.NESTED, r"\d\s*\("), (tx.CLAUSE, r"\d\s*\("), (tx.ARTICLE, r"art(?:icle|\.)?\s*\d"), (tx.RULE, r"\d\s*[-_ ]\s*[a-z0-9]"), (tx.HYPHEN, r"\d\s*[-_]\s*[a-z]")]
    for pattern, sign in cases:
        x = d.select(F.lower("t").rlike(pattern).alias("match"), F.lower("t").rlike(sign).alias("sign")).where("match")
        assert x.count() > 0 and x.where("not sign").count() == 0, pattern
    got = {r["id"]: r["k"] for r in d.select("id", tx.statutory_tokens(F.col("t")).alias("k")).collect()}
    assert got[3] == ["article 6", "article6", "art 6"] and got[14] == [] and got[21] is None


def test_texts_are_cut_once(spark, tmp_path):
    d = spark.createDataFrame([(i, "en" if i % 3 else None, t) for i, t in enumerate(TEXTS * 3)], "id int, lang string, t string")
    terms = rk.query_terms(spark.createDataFrame([(1, "Section 3(p) rule 158B of part", None)], "query_id int, query string, jurisdiction string"), tokenizer=tx.legal_tokens)
    whole = ix.build(d, "id", "lang", "t", terms.select("term"), tx.legal_tokens)
    once = ix.build(d, "id", "lang", "t", terms.select("term"), tx.legal_tokens, f"file://{tmp_path}/terms")
    for a, b in ((whole.tf, once.tf), (whole.df, once.df), (whole.stats, once.stats)):
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    found = rk.bm25(once, terms)
    assert not re.search("regexp_extract_all\\(lower\\(t#", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rk.bm25(whole, terms).collect()))
