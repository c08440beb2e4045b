import random

import pytest
from docweave.operators import contain
from docweave.operators import metrics as mt
from docweave.sources import corpus as cp


def strings(seed, n, longest, letters="abcA é"):
    r = random.Random(seed)
    return [(i, "".join(r.choice(letters) for _ in range(r.randrange(longest)))) for i in range(n)]


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("longest", [3, 9])
def test_contained_against_all_pairs(spark, longest):
    wholes = [*strings(1, 150, 60), (900, None), (901, ""), (902, "aa"), (903, "漢字 😀 b\nc"), (904, "漢字 😀 b\nc")]
    parts = [*strings(2, 150, longest), (910, None), (911, "  "), (912, "aa"), (913, "字 😀"), (914, "b\nc"), (915, "zzzz not there"), (916, "é"), (917, "x" * 500)]
    got = contain.contained(spark.createDataFrame(wholes, "w int, text string"), spark.createDataFrame(parts, "p int, text string"), "w", "p")
    want = [(w, p) for w, a in wholes for p, b in parts if a and b and b.strip(" ") and b in a]
    assert pairs(got) == sorted(want) and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_either_against_all_pairs(spark):
    a, b = strings(3, 80, 12, "ab"), strings(4, 80, 12, "ab")
    got = contain.either(spark.createDataFrame(a, "x int, text string"), spark.createDataFrame(b, "y int, text string"), "x", "y")
    assert pairs(got) == sorted((i, j) for i, s in a for j, t in b if s and t and (s in t or t in s))


def test_nothing_on_either_side(spark):
    some, none = spark.createDataFrame([(1, "abc")], "k int, text string"), spark.createDataFrame([], "k int, text string")
    assert contain.contained(some, none, "k", "k").count() == contain.contained(none, some, "k", "k").count() == contain.contained(none, none, "k", "k").count() == 0


def test_locate_finds_the_first_of_the_best_kind(spark):
    found = [("Patents Act.pdf", "/a"), ("patents act.pdf", "/b"), ("The Patents-Act 1970.pdf", "/c"), ("TRIPS.pdf", "/d"), ("...", "/e"), ("Patents Act.pdf", "/0")]
    wanted = [("Patents Act.pdf",), ("PATENTS ACT.PDF",), ("patents_act_1970.pdf",), ("trips",), ("nothing",), (" ",), ("...",), (None,)]
    got = cp.locate(spark.createDataFrame(wanted, "filename string"), spark.createDataFrame(found, "name string, path string"))
    assert {r["filename"]: r["path"] for r in got.collect()} == {"Patents Act.pdf": "/0", "PATENTS ACT.PDF": "/0", "patents_act_1970.pdf": "/c", "trips": "/d", "nothing": None, " ": None, "...": "/e", None: None}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_published_figures_of_a_small_benchmark(spark):
    top = [(1, 1, "The Patents Act", "Section 3(p)", "t1"), (1, 2, "The Patents Act", "Section 9", "t1"), (2, 1, "TRIPS", "Article 27", "t2"), (2, 3, "PATENTS act", "section 3(D)", "t3"), (3, 1, None, None, None), (3, 2, "Other", "x", None)]
    gold = [(1, "patents", ["section 5", "SECTION 3(p)"]), (2, "Patents Act", ["3(d)"]), (3, "patents", ["x"])]
    judged = mt.judged(spark.createDataFrame(top, "query_id int, rank int, title string, section string, text string"), spark.createDataFrame(gold, "query_id int, gold_doc string, gold_sections array<string>"))
    assert sorted((r["query_id"], r["rank"]) for r in judged.where("gold").collect()) == [(1, 1), (2, 3)]
    questions = [(1, True, False, "yes", 100.0), (2, False, True, "yes", 300.0), (3, False, True, "It CANNOT be.", None), (4, True, True, None, 200.0)]
    rows = mt.benchmark(spark.createDataFrame(questions, "query_id int, exact boolean, negative boolean, answer string, latency_ms double"), judged)
    assert {r["query_id"]: (r["gold_rank"], r["hit"], r["negative_right"], r["duplicates"]) for r in rows.collect()} == {1: (1, True, None, 1), 2: (3, True, True, 0), 3: (None, False, True, 1), 4: (None, False, False, 0)}
    r = mt.published(rows).first()
    assert (r["n"], r["n_hit"], r["recall5"], r["mrr"], r["exact_recall5"], r["paraphrased_recall5"]) == (4, 2, 0.5, 0.333333, 0.5, 0.5)
    assert (r["n_negative"], r["negative_correct"], r["citation_accuracy"], r["duplicates"], r["mean_latency_ms"]) == (3, 0.666667, 0.5, 2, 200.0)


def test_pages_number_each_group_in_order(spark):
    rows = [(7 * i % 1000 - 300, "a" if i % 10 else None if i % 3 else "b") for i in range(1000)]
    got = cp.paged(spark.createDataFrame(rows, "k int, g string").repartition(5), "g", "k", 30).collect()
    for g in ("a", "b", None):
        mine = sorted((r["page"], r["place"], r["k"]) for r in got if r["g"] == g)
        keys = sorted(k for k, x in rows if x == g)
        assert mine == [(n // 30, n % 30, k) for n, k in enumerate(keys)]
    assert cp.paged(spark.createDataFrame([], "k int, g string"), "g", "k", 30).count() == 0


def test_grams_are_found_without_expressions_for_each_place(spark):
    wholes, parts = spark.createDataFrame(strings(7, 50, 60), "w int, text string"), spark.createDataFrame(strings(8, 50, 9), "p int, text string")
    plan = contain.contained(wholes, parts, "w", "p")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_long_parts_and_other_gram_sizes(spark):
    wholes = [*strings(9, 120, 80), (900, "x😀yz漢字 end"), (901, "\0\0c"), (902, "c")]
    parts = [*strings(10, 120, 7), (910, "😀yz漢"), (911, "c"), (912, "\0\0c")]
    want = sorted((w, p) for w, a in wholes for p, b in parts if a and b and b.strip(" ") and b in a)
    for gram in (1, 2, 5):
        assert pairs(contain.contained(spark.createDataFrame(wholes, "w int, text string"), spark.createDataFrame(parts, "p int, text string"), "w", "p", gram=gram)) == want
