import pytest
from docweave.plans import ingest as ig
from docweave.sources import corpus as cp
from pyspark.sql import functions as F

ACT = "1. Short title of this Act which is long enough to be kept as a section of its own here.\n2. Turmeric and neem are plants whose extracts are known since long and not new at all in this country."
LONG = ACT + "\n3. What are not inventions: traditional knowledge, or what aggregates known properties of known components."
NAMES = {"A": "act_a.txt", "B": "act_b.txt", "C": "2016DrugsandCosmeticsAct.txt"}


def manifest(spark, *ids):
    row = dict.fromkeys(cp.MANIFEST_COLUMNS, "")
    rows = [row | {"id": i, "title": f"Act {i}", "jurisdiction": "National", "chunk_strategy": "section", "filename": NAMES.get(i, "")} for i in ids]
    return spark.createDataFrame([tuple(r[c] for c in cp.MANIFEST_COLUMNS) for r in rows], cp.MANIFEST)


def texts(spark, **of):
    x = spark.createDataFrame(list(of.items()), "id string, text string")
    return x.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def held(spark, place):
    n = {r["document_id"]: r["n"] for r in ig.points(spark, place).groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    s = {r["id"]: (r["total_chunks"], r["run"]) for r in ig.state(spark, place).where("content_hash is not null").collect()}
    assert all(r["whole"] for r in ig.checked(spark, place).collect())
    assert n == {i: t for i, (t, _) in s.items() if t}
    return s


def test_runs_follow_the_documents(spark, tmp_path):
    place, m = f"{tmp_path}/corpus", manifest(spark, "A", "B", "C", "D")
    assert held(spark, place) == {}
    assert ig.run(spark, place, m, texts(spark, A=LONG, B=ACT, C=None), "2024-01-01") == 1
    assert held(spark, place) == {"A": (3, 1), "B": (2, 1), "C": (0, 1)}
    assert ig.run(spark, place, m, texts(spark, A=LONG, B=ACT, C=None), "2024-01-02") is None
    # A has become shorter, D is new and not a part of the manifest is not taken; B is not among the texts
    assert ig.run(spark, place, m, texts(spark, A=ACT, D=LONG, X=LONG), "2024-01-03") == 2
    assert held(spark, place) == {"A": (2, 2), "B": (2, 1), "C": (0, 1), "D": (3, 2)}
    assert ig.run(spark, place, m, texts(spark, A=ACT, D=LONG), "2024-01-04", complete=True) == 3
    assert held(spark, place) == {"A": (2, 2), "D": (3, 2)}
    assert ig.run(spark, place, m, texts(spark, A=ACT, B=ACT, D=LONG), "2024-01-05", complete=True) == 4
    assert held(spark, place) == {"A": (2, 2), "B": (2, 4), "D": (3, 2)}
    other = f"{tmp_path}/settled"
    ig.settle(spark, place, other)
    assert held(spark, other) == {"A": (2, 1), "B": (2, 1), "D": (3, 1)}
    assert ig.run(spark, other, m, texts(spark, A=ACT, B=ACT, D=LONG), "2024-01-06", complete=True) is None


def test_equal_and_null_identifiers(spark, tmp_path):
    place = f"{tmp_path}/corpus"
    t = texts(spark, A=ACT).union(texts(spark, A=ACT)).union(texts(spark, A=LONG)).union(texts(spark, B=ACT).withColumn("id", F.lit(None).cast("string")))
    assert ig.run(spark, place, manifest(spark, "A", "B"), t, "2024-01-01") == 1
    s = held(spark, place)
    least = t.where("id is not null").agg(F.min_by("text", "content_hash")).first()[0]
    assert s == {"A": (2 if least == ACT else 3, 1)}


def test_a_killed_run_leaves_what_was_there(spark, tmp_path, monkeypatch):
    place, m = f"{tmp_path}/corpus", manifest(spark, "A", "B")
    ig.run(spark, place, m, texts(spark, A=LONG), "2024-01-01")
    before = held(spark, place)

    def failing():
        def embed(texts):
            if any("plants" in t for t in texts):
                raise RuntimeError("killed")
            return [[1.0] for _ in texts]

        return embed

    with pytest.raises(Exception, match="killed"):  # while points are written
        ig.run(spark, place, m, texts(spark, A=ACT, B=LONG), "2024-01-02", embed=failing)
    assert held(spark, place) == before
    write = ig._write

    def dies_before_the_state(rows, place, table, run):
        if table == "state":
            raise RuntimeError("killed")
        write(rows, place, table, run)

    with monkeypatch.context() as x, pytest.raises(RuntimeError, match="killed"):
        x.setattr(ig, "_write", dies_before_the_state)
        ig.run(spark, place, m, texts(spark, A=ACT + " x", B=LONG), "2024-01-02")
    assert held(spark, place) == before
    assert ig.run(spark, place, m, texts(spark, A=ACT, B=ACT), "2024-01-02") == 2
    assert held(spark, place) == {"A": (2, 2), "B": (2, 2)}


def test_files_are_read_if_they_are_due(spark, tmp_path):
    folder, place, m = tmp_path / "files", f"{tmp_path}/corpus", manifest(spark, "A", "B", "C", "D")
    folder.mkdir()
    for i, text in (("A", LONG), ("B", ACT), ("C", ACT)):
        (folder / NAMES[i]).write_text(text)
    seen = tmp_path / "seen"
    seen.mkdir()

    def reader(content):
        (seen / str(hash(content))).touch()
        return content.decode().split("\f")

    assert ig.run_files(spark, place, m, str(folder), reader, "2024-01-01") == 1
    assert held(spark, place) == {"A": (3, 1), "B": (2, 1), "C": (2, 1)}
    assert {r["id"]: r["extraction_method"] for r in ig.state(spark, place).collect()} == {"A": "native", "B": "native", "C": "targeted_native"}
    for f in seen.iterdir():
        f.unlink()
    (folder / NAMES["B"]).write_text(LONG + " And more of it.")
    assert ig.run_files(spark, place, m, str(folder), reader, "2024-01-02") == 2
    assert held(spark, place) == {"A": (3, 1), "B": (3, 2), "C": (2, 1)} and len(list(seen.iterdir())) == 1
    (folder / NAMES["A"]).unlink()
    assert ig.run_files(spark, place, m, str(folder), reader, "2024-01-03", complete=True) == 3
    assert set(held(spark, place)) == {"B", "C"}
