import random
import uuid

import pytest
from docweave.streaming import memo
from pyspark.sql import functions as F


def loop(log, capacity):
    held, epoch, out = set(), None, []
    for at, k in log:
        hit = k in held
        if not hit:
            if len(held) >= capacity:
                held.clear()
            if not held:
                epoch = at
            held.add(k)
        out.append((at, k, epoch, hit))
    return out


def of(spark, tmp_path, log, capacity, width):
    x = spark.createDataFrame(log, "at bigint, key string").repartition(3)
    return sorted((r["at"], r["key"], r["epoch"], r["hit"]) for r in memo.replay(x, "at", "key", f"file://{tmp_path}/{uuid.uuid4().hex}", capacity, width).collect())


@pytest.mark.parametrize("n,keys,capacity,width", [(600, 40, 7, 50), (300, 9, 8, 20), (200, 30, 3, 1000), (150, 60, 1, 10)])
def test_as_a_loop_has_it(spark, tmp_path, n, keys, capacity, width):
    rng = random.Random(n)
    log = [(3 * i + 5, None if (k := int(rng.expovariate(5 / keys))) == 2 else f"k{k}") for i in range(n)]
    assert of(spark, tmp_path, log, capacity, width) == loop(log, capacity)


def test_one_key_for_long_and_gaps(spark, tmp_path):
    log = [(i, "hot") for i in range(300)] + [(i, f"k{i % 5}") for i in range(900, 960)] + [(i, "hot") for i in range(2000, 2100)]
    assert of(spark, tmp_path, log, 3, 20) == loop(log, 3)
    assert of(spark, tmp_path, log, 100, 20) == loop(log, 100)


def test_an_empty_log(spark, tmp_path):
    assert of(spark, tmp_path, [], 3, 20) == []


def test_keys(spark):
    x = spark.createDataFrame([(" What? ", "National ", None), ("what?", "national", None), ("what?", "national", "")], "q string, j string, c string")
    a, b, c = (r[0] for r in x.select(memo.memo_key(F.col("q"), F.col("j"), F.col("c"))).collect())
    assert a == b != c
