import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import winnowing as wn

from helpers import AWKWARD, documents, rows, words


def slow_hash(gram):
    h = 0
    for c in gram:
        h = (h * wn._BASE + ord(c)) % (1 << 64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * by) % (1 << 64)
    return (h ^ (h >> 31)) >> 32


def slow(text, k, w):
    """Each window by itself."""
    if not text:
        return []
    if len(text) < k:
        return [(int.from_bytes(hashlib.blake2b(text.encode("utf-32-le"), digest_size=4).digest(), "little"), 0)]
    hashes = [slow_hash(text[i : i + k]) for i in range(len(text) - k + 1)]
    found = []
    for at in range(max(1, len(hashes) - w + 1)):
        window = hashes[at : at + w]
        last = max(i for i, h in enumerate(window) if h == min(window))
        if (window[last], at + last) not in found:
            found.append((window[last], at + last))
    return found


def unpacked(fingerprint):
    return [(f >> 32, f & 0xFFFFFFFF) for f in fingerprint.tolist()]


TEXTS = ["", "a", "short", "exactly sixteen!", "x" * 200, "ab" * 90, " ".join(words(1, 60)), "é漢😀" * 30, " ".join(words(2, 9)) + "\n" * 40 + " ".join(words(3, 20))]


@pytest.mark.parametrize("k,w", [(16, 16), (4, 8), (1, 1), (8, 1)])
@pytest.mark.parametrize("block", [1 << 20, 7])
def test_against_each_window_by_itself(k, w, block):
    for t in TEXTS:
        assert unpacked(wn.winnow(t, k, w, block)) == slow(t, k, w)


def test_ties_go_to_the_right():
    assert [p for _, p in unpacked(wn.winnow("x" * 100, 4, 8))] == list(range(7, 97))


def test_shared_characters_are_always_found():
    shared = " ".join(words(5, 40))[: wn.K + wn.W - 1]
    for n in range(30):
        a, b = (" ".join(words(100 + 2 * n + i, 3 + n)) for i in (0, 1))
        x, y = (dict(unpacked(wn.winnow(t))) for t in (f"{a} {shared} {b}", f"{b}{a} {shared}{b}"))
        assert any(x[h] - len(a) - 1 == y[h] - len(b + a) - 1 and 0 <= x[h] - len(a) - 1 <= len(shared) - wn.K for h in set(x) & set(y))


def by_hand(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        own, other, following = ([*slow(t, wn.K, wn.W)] for t in (text, new, after))
        sets = [{h for h, _ in f} for f in (own, other, following)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        text_of = lambda f: ",".join(f"{h:08x}:{p}" for h, p in f)
        out.append({"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": text_of(own), "edited_fingerprint": text_of(other), "near_edited": near[0], "near_next": near[1]})
    return sorted(out, key=lambda r: str(sorted(r.items(), key=str)))


DOCS = [*AWKWARD, *((100 + 3 * i, " ".join(words(i % 17, 1 + 7 * (i % 17)))) for i in range(80)), (50, "z" * 300), (51, "z" * 300), (-4, "before all but the null one")]


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_compared_with_the_successor(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows(wn.op12(documents(spark, DOCS[::-1]).repartition(3)).drop("more"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == by_hand(DOCS)


def test_one_document_is_its_own_successor(spark):
    got = wn.op12(documents(spark, [(5, "twenty characters ok")])).first()
    assert got["near_next"] == 1.0
    assert got["edited_sha256"] == hashlib.sha256(b"twenty charactetwent").hexdigest()


def test_repeated_rows_at_the_edges_of_ranges(spark):
    docs = [(7, "the same row in every range " * 3)] * 400 + [(8, "another one " * 5)]
    assert rows(wn.op12(documents(spark, docs))) == by_hand(docs)


def test_empty_table(spark):
    x = wn.op12(documents(spark, []))
    assert x.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert x.count() == 0


def test_columns_of_fingerprints_and_their_likeness(spark):
    docs = documents(spark, DOCS).selectExpr("*", "1 as hash", "2 as position", "3 as range")
    got = wn.fingerprints(wn.fingerprints(docs), out="again").withColumn("near", wn.alike(F.col("fingerprint"), F.col("again")))
    assert got.where("hash = 1 and position = 2 and range = 3 and near = 1").count() == len(DOCS)
    for r in got.collect():
        assert [(p["hash"], p["position"]) for p in r["fingerprint"]] == slow(r["text"] or "", wn.K, wn.W)


def test_a_very_long_text(spark):
    text = " ".join(words(9, 400_000, 50_000))
    whole = wn.winnow(text)
    assert (wn.winnow(text, block=1 << 14) == whole).all()
    assert np.mean(np.diff(whole & np.uint64(0xFFFFFFFF))) < wn.W
    got = wn.op12(documents(spark, [(1, text), (2, "b"), (3, text)])).orderBy("doc_id").collect()
    assert got[0]["fingerprint"] == got[2]["fingerprint"] == wn.written(whole)
    assert 0.55 < got[0]["near_edited"] < 1 and got[0]["near_next"] == 0
