import random
import re

import numpy as np
import pytest
from docweave.llm import common
from docweave.llm import jaccard_join as j
from docweave.llm.graph import components

from helpers import AWKWARD, documents, words


def shingles(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def edited(r, w, share):
    w = list(w)
    for _ in range(int(len(w) * share)):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], [f"z{r.randrange(50)}"], [w[i], w[i]]])
    return w


def near_rows(seed, groups=14):
    r, rows, n = random.Random(seed), [], 0
    passage = words(999, 60, 5000)
    for g in range(groups):
        base = words(seed * 100 + g, r.choice([3, 6, 8, 12, 20, 31, 33, 60, 64, 130, 250, 600]), 5000)
        for _ in range(r.randrange(1, 9)):
            w = edited(r, base, r.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))
            if r.random() < 0.2:
                w = w + passage
            rows.append((n := n + 1, " ".join(w)))
    r.shuffle(rows)
    return rows


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 500_000 if seed == 1 else 0)
    rows = near_rows(seed) + AWKWARD + [(900, "one two"), (901, "ONE  two"), (902, "one two three"), (903, " ".join(words(5, 20_000))), (904, " ".join(words(5, 20_000)[30:]))]
    assert got(j.op4(documents(spark, rows))) == brute(rows)


def test_large_near_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 16)
    r = random.Random(7)
    base = words(77, 120, 5000)
    rows = [(i, " ".join(edited(r, base, 0.02))) for i in range(150)] + [(1000 + i, " ".join(base[:70] + words(500 + i, 60, 5000))) for i in range(60)]
    assert got(j.op4(documents(spark, rows))) == brute(rows)


def test_linked_sets_share_a_key():
    r = np.random.default_rng(3)
    for n in [4, 5, 7, 8, 9, 15, 16, 31, 33, 63, 64, 65, 100, 127, 128, 200, 500, 1023, 1030]:
        for _ in range(60):
            a = r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            m = int(r.integers(n, 100 * n // 80 + 1))
            d = j.most_apart(n + m, 80)
            drop = max(0, (d - (m - n)) // 2)
            b = np.concatenate([a[drop:], r.integers(0, 2**63, m - n + drop, dtype=np.int64).astype(np.uint64)])
            shared = n - drop
            seed = int(r.integers(1, 50))
            times = lambda k, seed=seed: k * seed % 7
            assert 100 * shared >= 80 * (n + len(b) - shared)
            assert filed(a, times) & filed(b, times) or len(a) == len(b) and drop == 0


def filed(hashes, times):
    """Keys that a set files if key counts are as times says; none is one set's own."""
    out = set()
    for keys, spare in j.chunk_keys(np.unique(hashes)):
        order = sorted(keys.tolist(), key=lambda k: (-times(k), -k))
        out |= set(order[spare:])
    return out


def test_sketch_distance_bounds_difference():
    r = np.random.default_rng(4)
    for n in [1, 5, 60, 64, 100, 300, 1000, 1025]:
        a = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        for m in [0, 1, n // 10, n // 2]:
            b = np.concatenate([a[m:], r.integers(0, 2**63, m + n // 4, dtype=np.int64).astype(np.uint64)])
            d = len(a) + len(b) - 2 * (len(a) - min(m, len(a)))
            assert j.distance(j.wide_sketch(a), j.wide_sketch(b)) <= d


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, 7), (500, 400)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, df.collect())) == sorted((x, find(x)) for x in root)


def test_empty_and_clashing(spark):
    docs = documents(spark, AWKWARD)
    assert j.op4(docs.limit(0)).count() == 0
    assert got(j.op4(docs.selectExpr("*", "1 as node", "2 as n", "3 as keys"))) == brute(AWKWARD)


def counted(monkeypatch):
    """Rows of the work tables, by name."""
    rows, write = {}, j.materialize

    def count(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(j, "materialize", count)
    return rows


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    rows = counted(monkeypatch)
    passage = words(998, 260, 10**6)
    docs = [(i, " ".join(passage + words(3000 + i, 640, 10**6))) for i in range(120)]
    docs += [(1000 + i, " ".join(words(4000, 40, 10**6)[: 20 + i % 20] + words(5000 + i, 50, 10**6))) for i in range(120)]
    assert got(j.op4(documents(spark, docs))) == brute(docs)
    assert rows["across"] + rows["tested"] < 20, rows


def test_copies_file_their_keys_once(spark, monkeypatch):
    rows = counted(monkeypatch)
    text = words(11, 300, 10**6)
    docs = [(i, " ".join(text)) for i in range(400)] + [(1000 + i, " ".join([*text[:-1], f"x{i % 3}"])) for i in range(400)]
    assert got(j.op4(documents(spark, docs))) == brute(docs)
    assert rows["repeated"] < 8 * 400, rows


def test_identifiers_that_name_no_row(spark):
    base = words(12, 200, 10**6)
    docs = [(None, " ".join(words(i, 60, 10**6))) for i in range(40)] + [(None, " ".join([*base, "x"])), (5, " ".join(base)), (5, " ".join([*base, "y"])), (5, "other"), (None, "other")]
    assert got(j.op4(documents(spark, docs))) == brute(docs)
