import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm.fill_middle import SENTINELS, arrange, op11, restored

from helpers import AWKWARD, documents, rows, words

TEXTS = [*AWKWARD, (8, "a <P> of its own"), (9, "<M>"), (10, "<S"), (11, "x<P"), (12, "P>S>"), (13, "a|b\\E$1\n\n<"), (14, "ab" * 40_000 + " !?" * 20_000), *((20 + i, " ".join(words(i, 5 + i)) + ".\né漢😀") for i in range(60))]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in SENTINELS) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return {"doc_id": doc_id, "n": n, "form": form, "prefix_chars": sizes[0], "middle_chars": sizes[1], "output_sha256": sha(out), "restored_sha256": sha(text)}


def test_rows_are_those_made_by_hand(spark):
    want = sorted((by_hand(*t[:2]) for t in TEXTS), key=lambda r: str(sorted(r.items(), key=str)))
    assert rows(op11(documents(spark, TEXTS))) == want
    assert {r["form"] for r in want} == {"plain", "psm", "spm"}


def test_other_columns_stay_whatever_they_are_called(spark):
    docs = documents(spark, TEXTS[:9]).selectExpr("*", "1 as units", "2 as row", "3 as body", "4 as n", "5 as form", "6 as fim", "7 as `a.b`")
    got = arrange(docs)
    assert got.columns == [*(c for c in docs.columns if c != "fim"), "fim"]
    assert got.where("units = 1 and row = 2 and body = 3 and n = 4 and form = 5 and `a.b` = 7").count() == 9


def test_parts_make_the_output_and_the_text(spark):
    got = arrange(documents(spark, TEXTS), plain_percent=0, spm_percent=50).select("text", "fim.*").withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert r["again"] == (r["text"] or "")
        if r["form"] != "plain":
            assert r["prefix"] + r["middle"] + r["suffix"] == r["text"]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("percents", [(100, 0), (0, 100), (0, 0)])
def test_percents(spark, percents):
    got = arrange(documents(spark, TEXTS[20:]), plain_percent=percents[0], spm_percent=percents[1]).select("fim.form").distinct().collect()
    assert [r[0] for r in got] == [{(100, 0): "plain", (0, 100): "spm", (0, 0): "psm"}[percents]]


def test_empty_table_and_a_plan_without_python_or_shuffles(spark):
    x = op11(documents(spark, []))
    assert x.count() == 0
    plan = op11(documents(spark, TEXTS[:3]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    assert len(re.findall("regexp_extract_all", plan)) == 1
