"""The jobs on growing input: what is new is taken, what is there stays, and a run that failed is made good by the next."""

import ast
import datetime
import json
import subprocess
import sys
from pathlib import Path

import pytest
from jobs import common, ingest_passages, usage_report
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
SMALL = ingest_passages.Config(block_words=3, passage_blocks=2, shared_blocks=1, ids_per_part=10, files_per_batch=2)


def add(spark, path, rows):
    schema = f"{ingest_passages.DOCUMENTS}, more int"
    spark.createDataFrame([(i, t, "EN", "s", 1) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(path)


def by_hand(versions, config=SMALL):
    out = []
    for i, text in versions.items():
        words = (text or "").split()
        blocks = [words[a : a + config.block_words] for a in range(0, len(words), config.block_words)]
        step = config.passage_blocks - config.shared_blocks
        starts = range(0, max(len(blocks) - config.shared_blocks, 1), step)
        out += [(i, n, " ".join(w for b in blocks[a : a + config.passage_blocks] for w in b), i // config.ids_per_part) for n, a in enumerate(starts)]
    return sorted(out)


def stored(spark, path):
    rows = spark.read.parquet(path).select("doc_id", "passage", "text", "n_words", "part").collect()
    assert all(r["n_words"] == len(r["text"].split()) for r in rows)
    return sorted((r["doc_id"], r["passage"], " ".join(r["text"].split()), r["part"]) for r in rows)


def files(spark, path, column):
    return {r[0]: r[1] for r in spark.read.parquet(path).groupBy(column).agg(F.sort_array(F.collect_set("_metadata.file_path"))).collect()}


@pytest.fixture
def at(tmp_path):
    return [f"file://{tmp_path}/{n}" for n in ("documents", "passages", "checkpoint")]


def test_passages_follow_growing_documents(spark, at):
    text = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    now = {1: text(20), 2: None, 3: "   ", 15: text(6), 25: text(7)}
    add(spark, at[0], now.items())
    add(spark, at[0], [(None, "no identifier")])
    assert ingest_passages.run(spark, *at, SMALL).columns == [c.split()[0] for c in ingest_passages.PASSAGES.split(", ")]
    assert stored(spark, at[1]) == by_hand(now)
    before = files(spark, at[1], "part")

    ingest_passages.run(spark, *at, SMALL)  # nothing new
    assert files(spark, at[1], "part") == before

    new = {1: text(4, "v"), 16: text(9), 41: "one\nline  and\tanother"}  # shorter, beside another one, in a part of its own
    add(spark, at[0], [*new.items(), (25, now[25])])  # and one as it was
    ingest_passages.run(spark, *at, SMALL)
    assert stored(spark, at[1]) == by_hand(now | new)
    after = files(spark, at[1], "part")
    assert after[2] == before[2]  # the part of 25 is not written again
    assert after[0] != before[0] and after[1] != before[1] and set(after) == {0, 1, 2, 4}


def test_many_files_and_equal_identifiers_in_one_batch(spark, at):
    for n in range(5):
        add(spark, at[0], [(n, f"text {n}"), (7, "the same"), (7, "the same")])
    ingest_passages.run(spark, *at, SMALL)
    assert stored(spark, at[1]) == by_hand({**{n: f"text {n}" for n in range(5)}, 7: "the same"})


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_run_that_failed_is_made_good(spark, at, monkeypatch, when):
    add(spark, at[0], [(1, "a b c d e f g h"), (12, "i j")])
    ingest_passages.run(spark, *at, SMALL)
    add(spark, at[0], [(1, "x"), (12, "y y y y"), (30, "z")])
    real = ingest_passages.upsert

    def failing(*args):
        if when == "after":
            real(*args)
        raise RuntimeError("stopped here")

    monkeypatch.setattr(ingest_passages, "upsert", failing)
    with pytest.raises(Exception, match="stopped here"):
        ingest_passages.run(spark, *at, SMALL)
    monkeypatch.undo()
    ingest_passages.run(spark, *at, SMALL)
    assert stored(spark, at[1]) == by_hand({1: "x", 12: "y y y y", 30: "z"})


def test_a_write_that_fails_leaves_the_old_parts(spark, at):
    add(spark, at[0], [(1, "a b c d e f g h"), (12, "i j")])
    ingest_passages.run(spark, *at, SMALL)
    broken = spark.createDataFrame([(1, "x", "en", "s", datetime.datetime(2025, 1, 1), "f")], f"{ingest_passages.DOCUMENTS}, at timestamp, file string")
    broken = broken.withColumn("text", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("unreadable"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="unreadable"):
        ingest_passages.upsert(broken, 9, spark, at[1], SMALL)
    assert stored(spark, at[1]) == by_hand({1: "a b c d e f g h", 12: "i j"})


def test_no_documents(spark, at):
    add(spark, at[0], [])
    assert ingest_passages.run(spark, *at, SMALL).count() == 0


def log_events(spark, path, rows):
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def day(d, h=1):
    return datetime.datetime(2024, 3, d, h)


def test_the_report_follows_a_growing_log(spark, tmp_path):
    events, report = f"file://{tmp_path}/events", f"file://{tmp_path}/report"
    log_events(spark, events, [(1, day(1), 1, "ask", 10.0), (2, day(1, 23), 2, "ask", 30.0), (3, day(2), 1, "ask", 60.0), (4, day(2), None, None, None), (5, None, 1, "ask", 1.0)])
    got = {(r["day"].day, r["kind"]): r for r in usage_report.run(spark, events, report).collect()}
    assert set(got) == {(1, "ask"), (2, "ask"), (2, None)}
    one = got[1, "ask"]
    assert (one["n"], one["users"], one["mean"], one["least"], one["most"], one["fast"], one["mid"], one["slow"]) == (2, 2, 2000.0, 1000.0, 3000.0, 1, 1, 0)
    none = got[2, None]
    assert (none["n"], none["users"], none["mean"], none["fast"], none["slow"]) == (1, 0, None, 0, 0)
    before = files(spark, report, "day")

    usage_report.run(spark, events, report)
    assert files(spark, report, "day") == before

    log_events(spark, events, [(6, day(3), 3, "ask", 1.0), (7, day(1), 9, "rate", 1.0)])  # one of a new day, one late
    got = {(r["day"].day, r["kind"]): r["n"] for r in usage_report.run(spark, events, report).collect()}
    assert got == {(1, "ask"): 2, (1, "rate"): 1, (2, "ask"): 1, (2, None): 1, (3, "ask"): 1}
    after = files(spark, report, "day")
    assert [d.day for d in after if before.get(d) == after[d]] == [2]


def test_days_that_left_the_log_stay_in_the_report(spark, tmp_path):
    report = f"file://{tmp_path}/report"
    for n in (1, 2):
        log_events(spark, f"file://{tmp_path}/events{n}", [(n, day(n), 1, "ask", 1.0)])
        got = usage_report.run(spark, f"file://{tmp_path}/events{n}", report)
    assert sorted(r["day"].day for r in got.collect()) == [1, 2]


def test_only_the_time_of_events_that_are_reported_is_read(spark, tmp_path):
    events = f"file://{tmp_path}/events"
    log_events(spark, events, [(1, day(1), 1, "ask", 10.0)])
    plan = usage_report.due_days(spark.read.parquet(events), None)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp>" in plan


def test_configuration(spark, tmp_path):
    for module in (ingest_passages, usage_report):
        beside = (ROOT / "jobs" / f"{module.__name__.split('.')[-1]}.json").as_uri()
        assert common.configured(spark, beside, module.Config) == module.Config()
    (tmp_path / "c.json").write_text('{"unit_millis": 1}')
    with pytest.raises(TypeError, match="unit_millis"):
        common.configured(spark, f"file://{tmp_path}/c.json", usage_report.Config)


def test_command_lines(spark, tmp_path, at):
    add(spark, at[0], [(1, "a b c"), (2, "d")])
    (tmp_path / "c.json").write_text(json.dumps({"ids_per_part": 2}))
    out = subprocess.run([sys.executable, str(ROOT / "jobs/ingest_passages.py"), "--documents", at[0], "--passages", at[1], "--checkpoint", at[2], "--config", f"file://{tmp_path}/c.json"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "wrote 2 passages in 2 parts" in out.stderr
    assert stored(spark, at[1]) == [(1, 0, "a b c", 0), (2, 0, "d", 1)]


def test_jobs_need_nothing_optional():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), p
