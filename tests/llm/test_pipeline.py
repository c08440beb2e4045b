import corpus_pipeline as cp
from docweave.llm import decontaminate, packing
from docweave.llm.common import materialize

from helpers import AWKWARD, documents, rows, words
from test_decontaminate import brute as hits
from test_jaccard_join import brute as groups
from test_line_dedup import brute as lines
from test_quality_ledger import brute as measures


def corpus():
    text = lambda seed, n: " ".join(words(seed, n, 3000))
    out = [(i, text(i, 40 + i) + "\nShared footer of the site\n" + text(1000 + i, 30), "a" if i % 2 else "b") for i in range(60)]
    out += [(100 + i, text(5, 120) + f" end{i}", "c") for i in range(5)] + [(110, text(5, 120) + " end0", "d")]
    out += [(120, text(7, 80).upper(), "a"), (121, "x # y | " * 50, "a"), (122, "few words", "a")]
    item = text(77, 60)
    out += [(130, item + " " + text(8, 20), "c"), (131, text(9, 3000) + " " + item + " " + text(10, 300), "c")]
    return out + [(206, text(300, 40), "z")] * 2 + [(210 + i if d is not None else None, t, "z") for i, (d, t) in enumerate(AWKWARD)], [(1, item), (2, None)]


def test_stages_against_brute_force(spark, tmp_path):
    table, items = corpus()
    documents(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = [docs]
    for name, stage in cp.STAGES[:-1]:
        held.append(materialize(stage(spark, held[-1], str(tmp_path)), name))
        assert held[-1].columns == list(cp.COLUMNS)
    kept = [[(r["doc_id"], r["text"], r["source"]) for r in rows(d)] for d in held]

    ids = {r[0] for r in kept[1]}
    assert {120, 121, 122}.isdisjoint(ids) and set(range(60)) <= ids
    assert all(not measures(t)["base_failed"] for _, t, _ in kept[1])
    assert sorted((str(a), b) for a, b, _ in kept[2]) == sorted((a, b) for a, b, _ in lines(kept[1]))
    assert not any("Shared footer" in (t or "") for _, t, s in kept[2] if s in "ab")
    want = {d for d, _, c in groups([r[:2] for r in kept[2]]) if d == c}
    assert {str(r[0]) for r in kept[3] if r[0] is not None} == want - {"None"}
    assert len([r for r in kept[2] if r[0] == 206]) == 2 and len([r for r in kept[3] if r[0] == 206]) == 1
    assert len([r for r in kept[3] if 100 <= (r[0] or 0) <= 110]) == 1
    want = [r for r in kept[3] if not hits(r[1], items)[4]]
    assert {r[0] for r in kept[4]} == {r[0] for r in want} and 130 not in {r[0] for r in kept[4]}
    assert all(hits(t, items)[1] < 50 for _, t, _ in kept[4])
    assert all(a == b for a, b in zip(sorted(kept[4], key=str), sorted(want, key=str), strict=True) if hits(b[1], items)[1] < decontaminate.MAX_SPAN)

    final = cp.run(spark, str(tmp_path)).collect()
    tokens = packing.Tokens(packing.default_vocabulary())
    assert sum(r["length"] for r in final) == sum(len(tokens.ids(t or "")) for _, t, _ in kept[4])


def test_near_duplicates_without_clear_identifiers(spark):
    text = lambda seed, end: " ".join([*words(seed, 100, 3000), end])
    table = [(1, text(1, "a")), (2, text(1, "b")), (2, text(2, "only")), (None, text(1, "c")), (None, text(1, "c"))]
    table += [(5, text(3, "a")), (5, text(3, "b")), (5, text(3, "b")), (None, text(4, "a")), (None, text(4, "b")), (None, text(5, "only"))]
    table += [(8, text(6, "a"), "s"), (8, text(6, "a"), "t"), (9, "..."), (9, "..."), (None, " "), (None, " ")]
    got = rows(cp.near_duplicates(spark, documents(spark, table), ""))
    begun = lambda t: t.rsplit(" ", 1)[0]
    want = [(1, 1), (2, 2), (5, 3), (None, 4), (None, 5), (8, 6)]
    want = [(d, begun(text(seed, ""))) for d, seed in want] + [(9, "..."), (None, ""), (None, "")]
    assert sorted(((r["doc_id"], begun(r["text"])) for r in got), key=str) == sorted(want, key=str)
    assert (1, text(1, "a")) in [(r["doc_id"], r["text"]) for r in got]


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = documents(spark, AWKWARD + [(50, " ".join(words(1, 200, 10**6)))]).selectExpr("*", "1 as node", "2 as found", "'x' as _clean", "'y' as rid", "3 as bits", "'z' as mark")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == list(cp.COLUMNS), name
        assert stage(spark, odd, str(tmp_path)).where("doc_id = 50").count() == 1, name
    for name, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
