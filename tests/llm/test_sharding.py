from collections import defaultdict

import pytest
from docweave.llm import sharding as s

from helpers import AWKWARD, documents


def check(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    names = sorted(by)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    for rs in by.values():
        total = sum(r["n_bytes"] for r in rs)
        assert all(r["shard_bytes"] == total for r in rs)
        assert total <= limit or len(rs) == 1 and rs[0]["oversized"]
    for name in names:
        if name:
            under = sum(r["n_bytes"] for r in rows if r["shard"].startswith(name[:-1]))
            n = sum(1 for r in rows if r["shard"].startswith(name[:-1]))
            assert under > limit and n > 1
    return by


@pytest.mark.parametrize("limit", [300, 2000, 10**9])
def test_shards_fit_and_only_full_ones_split(spark, limit):
    rows = [(i, "x" * (i * 37 % 250 if i % 50 else 5000)) for i in range(300)]
    got = s.assign(documents(spark, rows), limit=limit).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    by = check(got, limit)
    assert len(by) > 1 or limit == 10**9
    d = {r["shard"]: r for r in s.directory(s.assign(documents(spark, rows), limit=limit)).collect()}
    assert sum(r["entries"] for r in d.values()) <= 2 ** max(r["depth"] for r in d.values())


def test_repeated_rows_and_nulls(spark):
    rows = AWKWARD + [(None, "n" * 100)] * 40 + [(9, "same" * 25)] * 40
    got = s.assign(documents(spark, rows), limit=1000).collect()
    assert len(got) == len(rows)
    check(got, 1000)


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * 20) for i in range(100)]
    s.write(documents(spark, rows), f"{tmp_path}/out", limit=2000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows


def test_empty_and_clashing(spark):
    docs = documents(spark, AWKWARD)
    assert s.op7(docs.limit(0)).count() == 0
    assert s.op7(docs.selectExpr("*", "1 as shard", "2 as bits", "3 as cell", "4 as key")).count() == len(AWKWARD)


def test_write_keeps_repeated_rows_and_long_texts(spark, tmp_path):
    docs = documents(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "x" * 300_000), (2, "x" * 300_000), (3, None)])
    s.write(docs, f"file://{tmp_path}/out", limit=1000)
    back = spark.read.parquet(f"file://{tmp_path}/out").drop("shard")
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
