import re
from collections import Counter

from docweave.llm import quality_ledger as q

from helpers import AWKWARD, documents, words


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": len(w) < 10 or 100 * len(hit) > 20 * len(w)}


def test_against_brute_force(spark):
    some = [(100 + i, " ".join(words(i, 300, 6 if i % 2 else 300))) for i in range(6)]
    some += [(200, "same line here\n" * 40), (201, "x # y | z *** " * 30), (202, "A\n\nA\n b\n b\nA"), (203, " ".join(words(1, 120_000)))]
    docs = documents(spark, AWKWARD + some)
    got = q.op2(docs).collect()
    assert len(got) == len(AWKWARD) + len(some)
    by_id = {}
    for i, t in AWKWARD + some:
        by_id.setdefault(i, brute(t))
    for r in got:
        assert {k: r[k] for k in by_id[r["doc_id"]]} == by_id[r["doc_id"]], r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_empty_and_clashing(spark):
    docs = documents(spark, AWKWARD)
    assert q.op2(docs.limit(0)).count() == 0
    odd = docs.selectExpr("*", "1 as bits", "'x' as n_words", "2 as kept")
    assert q.op2(odd).count() == len(AWKWARD)
    assert q.ledger(odd).columns[:8] == odd.columns


def test_policies_and_ablation(spark):
    good = " ".join(words(3, 60))
    docs = documents(spark, [(1, good), (2, good.upper()), (3, "few"), (4, good.replace(" ", " # ")), (5, (good + " # | ").upper() + "# " * 40)])
    led = q.ledger(docs)
    kept = {r[0] for r in led.where(q.verdict(led["_ledger"]["bits"], q.POLICIES["v1"])).select("doc_id").collect()}
    assert kept == {1}
    base = {r[0] for r in led.where(q.verdict(led["_ledger"]["bits"], q.POLICIES["base"])).select("doc_id").collect()}
    assert {1, 2, 4} <= base and 3 not in base
    ab = {r["rule"]: r for r in q.ablation(led, q.POLICIES["v1"]).collect()}
    assert ab["shouting"]["n_only"] == 1 and ab["shouting"]["n_kept_without"] == 2
    assert all(r["n_kept"] == 1 for r in ab.values())
