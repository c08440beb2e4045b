import hashlib
import random
from collections import Counter

import pytest
from docweave.llm import repeats as s

from helpers import AWKWARD, documents, words


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def mixed_rows(seed):
    r = random.Random(seed)
    passages = [" ".join(words(seed * 50 + i, r.choice([45, 60, 120, 300]), 3000)) for i in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts.append(" ".join(words(seed * 1000 + len(rows) * 7 + len(parts), r.randrange(0, 80), 3000)))
            p = r.choice(passages)
            a = r.randrange(0, len(p) // 2)
            parts.append(p[a : a + r.choice([150, 199, 200, 201, 230, 400, 3000])])
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(3)] + [(200, "é" * 150), (201, "xé" + "é" * 130), (202, "ab" * 300), (203, "q" * 450), (204, "q" * 200), (205, "k" * 200)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = mixed_rows(seed) + AWKWARD
    assert got(s.op6(documents(spark, rows))) == brute(rows)


def test_hot_anchors_agree(spark):
    rows = mixed_rows(4)
    assert got(s.dedup(documents(spark, rows), hot=3)) == brute(rows)


def test_long_text_and_kept_bytes(spark):
    long = " ".join(words(9, 60_000, 50_000))
    rows = [(1, long), (2, "start " + long[100_000:101_000] + " end"), (3, "alone " * 3)]
    x = {r["doc_id"]: r for r in s.dedup(documents(spark, rows), with_text=True).collect()}
    assert x[2]["kept"] in (b"start  end", b"start " + b" end") or len(x[2]["kept"]) <= 12
    assert x[1]["n_removed"] in range(1000, 1004) and x[1]["kept"] == (long[:100_000] + long[100_000 + x[1]["n_removed"] :]).encode() or x[1]["n_spans"] == 1
    assert x[3]["n_removed"] == 0


def test_repeats_list_all_occurrences(spark):
    passage = " ".join(words(11, 50, 3000))[:250]
    rows = [(i, " ".join(words(100 + i, 30, 3000)) + "|" + passage + "#" + str(i)) for i in range(5)]
    found = s.repeats(documents(spark, rows)).collect()
    whole = [r for r in found if r["length"] >= 200]
    assert {r["doc_id"] for r in whole} == set(range(5))
    top = Counter(r["repeat"] for r in whole).most_common(1)[0]
    assert top[1] == 5
    for r in whole:
        t = rows[r["doc_id"]][1].encode()[r["start"] : r["start"] + r["length"]]
        assert hashlib.md5(t).hexdigest() == r["repeat"]


def naive_repeats(lefts, rights, length):
    found = set()
    for i in range(len(rights)):
        for k in range(i):
            x, y = s.common(lefts[i], lefts[k]), s.common(rights[i], rights[k])
            if x + y >= length:
                found.add((lefts[i][:x], rights[i][:y]))
    return {(a, b): frozenset(m for m in range(len(rights)) if lefts[m].startswith(a) and rights[m].startswith(b)) for a, b in found}


def test_interval_tree_against_pairs():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(2, 9)
        lefts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 6))) for _ in range(n)]
        rights = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 7))) for _ in range(n)]
        got = {(lefts[m[0]][:x], rights[m[0]][:y]): frozenset(m) for m, x, y in s.group_repeats(lefts, rights, 4)}
        want = naive_repeats(lefts, rights, 4)
        assert all(want.get(k) == v for k, v in got.items())
        reach = s.cover(lefts, rights, 4)
        for m in range(n):
            mine = {(len(a), len(b)) for (a, b), ms in want.items() if m in ms}
            best = {z for z in mine if not any(w != z and w[0] >= z[0] and w[1] >= z[1] for w in mine)}
            assert set(reach.get(m, [])) == best


def test_empty_and_clashing(spark):
    docs = documents(spark, AWKWARD)
    assert s.op6(docs.limit(0)).count() == 0
    assert got(s.op6(docs.selectExpr("*", "1 as kid", "2 as mark", "3 as spans"))) == brute(AWKWARD)
