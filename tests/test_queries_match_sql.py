"""Every registered query of the library itself against its SQL, on the smallest driver tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest
from docweave.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = Path(SF, f"{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.inputFiles(), "it reads no table"
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLE:
        assert got
        return
    want = con.sql(registry.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_queries_read_whole_texts(spark, tmp_path):
    """A mark at the end of each long text, far behind its middle, is seen by the queries that pass texts on."""
    for t in ("documents", "conversations"):
        x = spark.read.parquet(f"{SF}/{t}.parquet").withColumn("text", F.concat("text", F.lit(" zzendmark")))
        x.write.parquet(f"{tmp_path}/{t}.parquet")
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "conversations")}
    for name, table, column in [("ordered_distinct", "documents", "words"), ("clean_footnotes", "documents", "text"), ("toc_filter", "documents", "text"), ("speech_clean", "documents", "text")]:
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert got.where(F.col(column).contains("zzendmark")).count() == got.count() == n[table], name
    got = registry.QUERIES["bm25_tf"](spark, str(tmp_path)).where("term = 'zzendmark'")
    assert got.count() == n["documents"]
    got = registry.QUERIES["answer_extract"](spark, str(tmp_path))
    assert got.where(F.col("answer").endswith(" zzendmark")).count() == got.count() > 0


def test_oracles_belong_to_queries():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
