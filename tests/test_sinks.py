import json
import os

import pytest
from docweave.streaming import sinks as sk
from pyspark.sql import functions as F

SCHEMA = "id bigint, said string"


@pytest.fixture
def at(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def add(at, n, rows):
    f = at / "in" / f"{n}.json"
    f.write_text("\n".join(json.dumps({"id": i, "said": s}) for i, s in rows))
    os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))


def log(at, export=True, project=None):
    one_line = lambda rows: rows.select("id", F.regexp_replace("said", "\n", " ").alias("said"), "batch")
    return sk.Log(f"{at}/table", SCHEMA, "id", f"{at}/export" if export else None, SCHEMA, project or one_line)


def run(spark, at, of):
    sk.append(of, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{at}/in"), f"{at}/checkpoint")


def rows(x):
    return sorted((r["id"], r["said"]) for r in x.collect())


ONE = [(2, "two\nlines"), (1, 'a "quoted, one"'), (3, " edges "), (4, ""), (5, None)]
LINES = [(1, 'a "quoted, one"'), (2, "two lines"), (3, " edges "), (4, ""), (5, None)]


def test_each_row_once_and_one_header_a_file(spark, at):
    of = log(at)
    add(at, 0, ONE)
    run(spark, at, of)
    add(at, 1, [(6, "six"), (6, "six")])
    run(spark, at, of)
    run(spark, at, of)
    assert rows(sk.table(spark, of)) == sorted(ONE, key=lambda r: r[0]) + [(6, "six")] * 2
    assert rows(sk.export(spark, of)) == LINES + [(6, "six")] * 2
    for f in (at / "export").rglob("*.csv"):
        lines = f.read_text().split("\n")
        assert lines[0] == "id,said" and "id,said" not in lines[1:]


def killed_after(rows):
    raise RuntimeError("killed")


@pytest.mark.parametrize("stopped", ["between the sinks", "behind the export"])
def test_a_run_that_was_killed(spark, at, stopped, monkeypatch):
    add(at, 0, ONE)
    run(spark, at, log(at))
    add(at, 1, [(7, "seven")])
    if stopped == "between the sinks":
        with pytest.raises(Exception, match="killed"):
            run(spark, at, log(at, project=killed_after))
    else:
        write = sk._export

        def then_dies(x, of):
            write(x, of)
            raise RuntimeError("killed")

        with monkeypatch.context() as m, pytest.raises(Exception, match="killed"):
            m.setattr(sk, "_export", then_dies)
            run(spark, at, log(at))
    assert sk.back_fill(spark, log(at)) == (stopped == "between the sinks")
    run(spark, at, log(at))
    assert rows(sk.table(spark, log(at))) == sorted([*ONE, (7, "seven")], key=lambda r: r[0])
    assert rows(sk.export(spark, log(at))) == [*LINES, (7, "seven")]


@pytest.mark.parametrize("most", [0, 1000])
def test_back_fill_of_what_is_lacking(spark, at, most, monkeypatch):
    monkeypatch.setattr(sk, "MOST_BATCHES", most)
    for n in range(4):
        add(at, n, [(10 * n + i, f"{n}") for i in range(3)])
    run(spark, at, log(at, export=False))
    assert sk.back_fill(spark, log(at)) == 4
    # a batch that is gone and one of which a row is gone
    (gone,) = (at / "export" / "batch=1").glob("*.csv")
    gone.unlink()
    (cut,) = (at / "export" / "batch=2").glob("*.csv")
    cut.write_text("\n".join(cut.read_text().split("\n")[:-2]) + "\n")
    for crc in (at / "export").rglob(".*.crc"):
        crc.unlink()
    assert sk.back_fill(spark, log(at)) == 2 and sk.back_fill(spark, log(at)) == 0
    assert rows(sk.export(spark, log(at))) == sorted((10 * n + i, f"{n}") for n in range(4) for i in range(3))


def test_nothing_to_append(spark, at):
    add(at, 0, [])
    run(spark, at, log(at))
    assert sk.table(spark, log(at)).count() == sk.export(spark, log(at)).count() == sk.back_fill(spark, log(at)) == 0
