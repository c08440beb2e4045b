from collections import Counter

from docweave.llm import line_dedup as ld

from helpers import AWKWARD, documents


def brute(rows):
    pages, counts = Counter(r[2] for r in rows), Counter()
    for _, t, s in rows:
        for m in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            counts[s, m] += 1
    out = []
    for i, t, s in rows:
        kept = None if t is None else [x for x in t.split("\n") if not x.strip(" \t\r") or counts[s, x.strip(" \t\r")] < 3 or counts[s, x.strip(" \t\r")] <= 0.1 * pages[s]]
        out.append((str(i), None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = [(i, t, None if (i or 0) % 2 else "host b") for i, t in AWKWARD]
    for i in range(60):
        host = "host a" if i % 3 else "host b"
        lines = [f"unique {i}", "  HOME | ABOUT \t\r", "" if i % 2 else "\t ", f"shared {i % 15}", f"pair {i // 2}", "HOME | ABOUT" if i % 5 == 0 else f"tail {i}"]
        rows.append((1000 + i, "\n".join(lines), host))
    rows += [(2000, "x\n" * 50_000 + "HOME | ABOUT", "host a")] + [(3000, "a\nb", None)] * 4
    docs = documents(spark, rows)
    got = sorted(((str(r["doc_id"]), r["text"], r["_lines_dropped"]) for r in ld.drop_lines(docs).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 60
    monkeypatch.setattr(ld, "BROADCAST_MARKS", 0)
    assert sorted(((str(r["doc_id"]), r["text"], r["_lines_dropped"]) for r in ld.drop_lines(docs).collect()), key=str) == got


def test_empty_clashing_and_native(spark):
    docs = documents(spark, AWKWARD)
    assert ld.op5(docs.limit(0)).count() == 0
    odd = docs.selectExpr("*", "1 as host", "2 as mark", "3 as host_pages", "4 as bad")
    assert ld.op5(odd).count() == len(AWKWARD)
    assert ld.drop_lines(odd).drop("_lines_dropped").columns == odd.columns
    assert "Python" not in ld.op5(docs)._jdf.queryExecution().toString()
