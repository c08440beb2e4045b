import os
from collections import Counter

import numpy as np
import pytest
from docweave.operators import language as lg
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def by_hand(texts):
    n = Counter()
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        s = f" {' '.join(words)} " if words else ""
        for k in (1, 2, 3):
            n.update(s[i : i + k] for i in range(len(s) - k + 1) if s[i : i + k] != " ")
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted((number(g) for g in n), key=lambda g: (-{number(x): c for x, c in n.items()}[g], g))[: lg.GRAMS]


def test_profiles_against_counting(monkeypatch):
    texts = ["The cat, the CAT and 12 dogs.", "Élan vital 漢字 😀", "", "...", "a"]
    assert lg.profile(texts).tolist() == by_hand(texts)
    assert lg.profile([]).tolist() == lg.profile(["", "1 2 3"]).tolist() == []
    monkeypatch.setattr(lg, "_BLOCK", 4)  # blocks meet without losing or doubling a gram
    assert lg.profile(texts).tolist() == by_hand(texts)


def test_distance_against_a_loop():
    own, other = np.array([5, 9, 1, 7]), np.array([9, 5, 3, 1])
    want = sum(abs(i - other.tolist().index(g)) if g in other else lg.GRAMS for i, g in enumerate(own.tolist()))
    assert lg.distance(own, np.sort(other), np.argsort(other)) == want


def test_scripts_profiles_and_default(spark):
    docs = spark.createDataFrame([("the house and the garden", "en"), ("das Haus und der Garten", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    p = lg.fit(docs)
    assert list(p) == ["de", "en"]
    asked = spark.createDataFrame([(1, "und das ist der Hund"), (2, "the end of the day"), (3, "नमस्ते the world"), (4, "12 34"), (5, None), (6, "")], "id int, text string")
    got = {r["id"]: r["code"] for r in asked.select("id", lg.detect(F.col("text"), p).alias("code")).collect()}
    assert got == {1: "de", 2: "en", 3: "hi", 4: "en", 5: "en", 6: "en"}
    assert asked.select(lg.nearest(F.col("text"), {}).alias("c")).where("c is not null").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_accuracy_on_documents_outside_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 100")
    fitted = docs.where("doc_id % 2 = 0")
    rest = docs.join(fitted.select("text"), "text", "left_anti")
    got = rest.select("lang", lg.detect(F.col("text"), lg.fit(fitted, sample=10)).alias("code"))
    assert got.count() > 50 and got.where("lang = code").count() >= 0.95 * got.count()
