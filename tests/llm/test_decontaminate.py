import hashlib
import random
import re

from docweave.llm import decontaminate as d

from helpers import AWKWARD, documents, words


def norm(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w, hit, names = norm(text), set(), set()
    for name, body in items:
        b = norm(body)
        windows = {tuple(b[i : i + 13]) for i in range(len(b) - 12)} if len(b) >= 13 else {tuple(b)} if b else set()
        for x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    names.add(str(name if name is not None else ""))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def case(seed, short):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(8)] + ["é", "über"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice(short)))) for i in range(8)]
    items += [(20, items[0][1]), (21, None), (22, " .,; "), (None, items[1][1])]
    docs = []
    for i in range(25):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 30)))]
        for _ in range(r.randrange(0, 3)):
            w = norm(r.choice(items)[1])
            a = r.randrange(0, max(1, len(w) - 13))
            parts += ["-".join(w[a : a + r.randrange(10, 40)]).upper(), " ".join(r.choice(vocabulary) for _ in range(9))]
        docs.append((i, ", ".join(parts)))
    return docs, items


def check(spark, docs, items, **more):
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = d.op3(documents(spark, docs), b) if not more else None
    if more:
        x = d.find_hits(documents(spark, docs), b, **more)
        got = x.select("doc_id", x["_found"]["n_words"].alias("n_words"), d.n_hit(x["_found"]).alias("n_hit"))
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    have = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], *((r["n_items"], r["items_sha256"], r["contaminated"]) if not more else ())) for r in got.collect())
    assert have == (want if not more else [w[:3] for w in want])


def test_long_items(spark):
    check(spark, *case(1, [13, 14, 20, 40, 60]))


def test_short_items(spark):
    check(spark, *case(2, [2, 5, 12, 13, 30]))


def test_one_word_items(spark):
    check(spark, *case(3, [1, 3, 15]))


def test_blocks_agree(spark):
    docs, items = case(4, [5, 13, 25])
    check(spark, docs, items, block_bytes=200)


def test_awkward_rows_and_long_text(spark):
    long = " ".join(words(5, 60_000))
    item = " ".join(long.split()[30_000:30_060])
    check(spark, [*AWKWARD, (500, "x " + item)], [(1, item), (2, "a b c d e f g h i j k l m")])
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    r = d.op3(documents(spark, [(1, long)]), b).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (60_000, 60, False)
    assert d.op3(documents(spark, AWKWARD), b.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert d.op3(documents(spark, AWKWARD).limit(0), b).count() == 0
    odd = documents(spark, AWKWARD).selectExpr("*", "1 as n_words", "2 as item_id", "'z' as _mark")
    assert d.op3(odd, b).count() == len(AWKWARD)


def test_clean_removes_spans(spark):
    item = " ".join(f"q{i}" for i in range(60))
    filler = " ".join(words(6, 3000))
    docs = documents(spark, [(1, item), (2, f"{filler}. {item}, end"), (3, filler), (4, None)])
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    b = b.unionByName(spark.createDataFrame([(2, "other item words " * 10), (3, "more " * 20)], "item_id bigint, text string"))
    got = {r["doc_id"]: r["text"] for r in d.clean(docs, b).collect()}
    assert got == {r["doc_id"]: r["text"] for r in d.clean(docs, b, block_bytes=100).collect()}
    assert set(got) == {2, 3, 4} and got[3] == filler and got[4] is None
    assert got[2] == f"{filler}. , end"
