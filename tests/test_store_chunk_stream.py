import json
import os
import time

from docweave.functions import models
from docweave.operators import chunk as ck
from docweave.operators import metrics as mt
from docweave.operators import store as st
from docweave.plans.q_store import ACT, TREATY
from docweave.sources import corpus as cp
from docweave.streaming import answers as an
from docweave.streaming import cache as ca
from pyspark.sql import functions as F

DELTAS = [
    ("a", 0, '{"ans'), ("a", 1, 'wer": "Sec'), ("a", 2, "tion 3(p)\\n"), ("a", 3, 'says \\"no'), ("a", 4, '\\".'), ("a", 5, '", "cit'), ("a", 6, 'ations": []'), ("a", 7, "}"),
    ("b", 0, "Just "), ("b", 1, "some "), ("b", 2, "plain "), ("b", 3, "text."), ("c", 0, "<think>hidden"), ("c", 1, ' still</think>{"answer":'), ("c", 2, ' "shown"}'), ("d", 0, "long plain words " * 4), ("d", 1, "more of the same " * 4), ("d", 2, "end"),
]


def test_sections_and_clauses():
    names = [n for n, _ in ck.chunk(ACT)]
    assert names[0].startswith("Section 1") and any(n.startswith("Section 2(1)(a)") and "invention" in n for n in names)
    assert any(n.startswith("Section 3") and "(Part 2)" in n for n in names)
    assert all(len(t) >= 60 for _, t in ck.chunk(ACT))
    assert ck.chunk(None) == ck.chunk("  ") == []
    arts = ck.articles(TREATY)
    assert [n.split(":")[0] for n, _ in arts][:2] == [ck.PREAMBLE, "Article 1"] and any(n.startswith("Article 2") for n, _ in arts)
    rules = ck.sections("158B. Labels and packing of all such drugs as are made here under these words of rule.\n159. Next rule.", "rule")
    assert [n for n, _ in rules] == ["Rule 158B — Labels and packing of all such drugs as are made here under ...", "Rule 159 — Next rule"]


def test_articles_as_the_patterns_give_them():
    text = "Article 5 the parties shall cooperate\nFAIR SHARING OF BENEFITS\nand more of it\n\nART. 6. Access\nto resources"
    # the title may begin with any letter, case being ignored throughout
    assert [n for n, _ in ck.articles(text)] == ["Article 5: the parties shall cooperate", "Article 6: Access"]
    assert [n for n, _ in ck.articles("Article 5\n\nFAIR SHARING OF BENEFITS\nof 2010\nArticle 6a — Use")] == ["Article 5: FAIR SHARING OF BENEFITS", "Article 6a: Use"]


def test_clauses_as_written_by_hand():
    lead = "2. Definitions.—In this Act, " + "unless it appears otherwise, " * 200
    clauses = ['(a) "invention" means a new product or process that involves a step and is of use in industry;', '(ja) "step" means a feature that involves an advance as compared to what is known already so far;', "(k) a short one;", '(l) "patent" means a patent for any invention that is granted under this Act and is in force now.']
    body = lead.strip() + "\n" + "\n".join(clauses)
    got = ck.subclauses("Section 2 — Definitions", body)
    head = "Section 2 — Definitions\n(1) In this Act, unless the context otherwise requires,—\n"
    assert got == [("Section 2 (Preamble/Definitions)", lead.strip()), *((f'Section 2(1)({x}) "{t}"', head + clauses[i]) for i, x, t in ((0, "a", "invention"), (1, "ja", "step"), (3, "l", "patent")))]
    # what stands before the clauses stays whole, however long
    assert [n for n, _ in ck.chunk(body)] == [n for n, _ in got] and len(ck.chunk(body)[0][1]) > 5000


def test_size_splitter_by_hand():
    assert ck.by_size("aa bb cc dd ee", 8, 3) == ["aa bb cc", "cc dd", "dd ee"]
    assert ck.by_size("aa bb cc dd ee", 8, 0) == ["aa bb cc", "dd ee"]
    assert ck.by_size("one\n\ntwo words here\n\nx", 8, 0) == ["one", "two", "words", "here", "x"]
    assert ck.by_size("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert ck.by_size("  ", 4, 1) == ck.by_size("", 4, 1) == [] and ck.by_size(" short ", 20, 5) == ["short"]


def test_size_splitter_keeps_all_words_within_size():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(i % 60)) for i in range(200)) + "x" * 5000
    parts = ck.by_size(text, 400, 50)
    assert max(map(len, parts)) <= 400
    assert {w for p in parts for w in p.split() if w.startswith("w")} == {w for w in text.split() if w.startswith("w") and len(w) < 300} | {w for p in parts for w in p.split() if w.startswith("w") and "x" in w}


def test_extractor_folds_and_streams(spark, tmp_path):
    got = {r["request_id"]: r["answer"] for r in an.extract(spark.createDataFrame(DELTAS, "request_id string, seq int, delta string")).collect()}
    assert got["a"] == 'Section 3(p)\nsays "no".' and got["b"] == "" and got["c"] == "shown" and got["d"].endswith("end")
    (tmp_path / "in").mkdir()
    half = len(DELTAS) // 2
    for n, part in enumerate((DELTAS[:half], DELTAS[half:])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("request_id", "seq", "delta"), d, strict=True))) for d in part))
    s = spark.readStream.schema("request_id string, seq int, delta string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = an.extract_stream(s).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    text = {}
    for r in spark.table("answers").collect():
        text[r["request_id"]] = text.get(r["request_id"], "") + r["text"]
    assert text == got


def batches(spark, tmp_path, name, schema, *parts):
    """A stream of one file after the other; the files are written in order, and read in that of their times."""
    (tmp_path / "in").mkdir()
    for n, part in enumerate(parts):
        f = tmp_path / "in" / f"{n}.json"
        f.write_text("\n".join(map(json.dumps, part)))
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def collected(spark, tmp_path, name, stream, **trigger):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(**trigger or {"availableNow": True}).start()


def test_repeated_and_late_deltas_are_dropped(spark, tmp_path):
    d = [{"request_id": "a", "seq": n, "delta": x} for n, x in enumerate(['{"answer": "', "one ", "two ", "three", '"}'])]
    s = batches(spark, tmp_path, "again", "request_id string, seq int, delta string", [d[0], d[2], d[1], d[1]], [d[1], d[3], d[2]], [d[4], d[3]])
    collected(spark, tmp_path, "again", an.extract_stream(s)).awaitTermination(120)
    rows = spark.table("again").orderBy("seq").collect()
    assert [(r["seq"], r["text"]) for r in rows] == [(2, "one two "), (3, "three"), (4, "")]


def test_stages_are_checked_over_batches(spark, tmp_path):
    e = lambda seq, stage: {"request_id": 1, "seq": seq, "stage": stage}
    s = batches(spark, tmp_path, "stages", "request_id bigint, seq bigint, stage string", [e(0, "b"), e(1, "error")], [e(1, "a"), e(2, "a"), e(3, "b")], [e(4, "what"), e(5, "a")])
    collected(spark, tmp_path, "stages", an.out_of_order_stream(s, ["a", "b"])).awaitTermination(120)
    assert [(r["seq"], r["stage"]) for r in spark.table("stages").orderBy("seq").collect()] == [(2, "a"), (4, "what")]


def test_what_has_expired_is_forgotten(spark, tmp_path):
    s = batches(spark, tmp_path, "expired", "request_id string, seq int, delta string", [{"request_id": "a", "seq": 5, "delta": '{"answer": "x'}])
    q = collected(spark, tmp_path, "expired", an.extract_stream(s, expiry_ms=1), processingTime="200 milliseconds")

    def waits_for(done):
        deadline = time.time() + 90
        while not done() and time.time() < deadline:
            time.sleep(0.3)
        assert done()

    try:
        waits_for(lambda: spark.table("expired").count() == 1)
        waits_for(lambda: q.lastProgress and q.lastProgress.stateOperators and q.lastProgress.stateOperators[0].numRowsTotal == 0)
        (tmp_path / "in" / "1.json").write_text(json.dumps({"request_id": "a", "seq": 0, "delta": '{"answer": "anew"'}))
        waits_for(lambda: spark.table("expired").count() == 2)
    finally:
        q.stop()
    assert [r["text"] for r in spark.table("expired").orderBy("seq").collect()] == ["anew", "x"]


def test_turn_memory_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"conv_id": 1, "turn": 5 * n + i, "query": f"q{5 * n + i}"}) for i in range(5)))
    s = spark.readStream.schema("conv_id bigint, turn bigint, query string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = an.recent_turns_stream(s).writeStream.format("memory").queryName("memory").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted({r["turn"] for r in spark.table("memory").collect()})[-3:] == [7, 8, 9]  # either file may come first


def test_turns_equal_the_state_machine(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "s"), ("assistant", "a0"), ("user", "u1"), ("user", "u2"), ("assistant", "a2"), ("assistant", "a3"), ("user", "u4"), ("system", "x"), ("assistant", "a5"), ("user", "")])]
    rows += [(1, 10, "assistant", "a6")]
    got = st.turns(spark.createDataFrame(rows, "c int, t int, role string, text string"), "c", "t", "role", "text", None).orderBy("turn").collect()
    assert [(r["query"], r["answer"]) for r in got] == [("u2", "a2"), ("u4", "a5")]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "id int, v string, version int")
    once = st.upsert(old, new, "id", "version")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, st.upsert(once, new, "id", "version").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    parts = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 0)], "document string, chunk int")
    assert st.replace_documents(parts, spark.createDataFrame([("x", 0)], "document string, chunk int"), "document").count() == 2


def test_audit_header_names_no_personal_data(spark):
    e = spark.createDataFrame([("t", "National", " a\nb ", None, "", 1.005, True, None, None)], "timestamp string, jurisdiction string, query string, classification string, provider_used string, latency_ms double, abstained boolean, conversation_id string, detected_lang string")
    a = st.audit_rows(e)
    assert a.columns == st.AUDIT_HEADER and not {"name", "email", "phone", "ip", "user"} & set(a.columns)
    assert tuple(a.first()) == ("t", "national", "a b", "", "none", 1.0, 1, "", "en")


def test_manifest_files_and_state(spark, tmp_path):
    header = ",".join(cp.MANIFEST_COLUMNS)
    (tmp_path / "m.csv").write_bytes(b"\xef\xbb\xbf" + f'{header}\n A ,"Act, 1970 ",x,,national,1,act,1970,"The Act, 1970.pdf",section,ACT,yearly,http://a\nB,T,x,c,International,2,treaty,,t.pdf,article,T,yearly,\n'.encode())
    m = cp.manifest(spark, f"{tmp_path}/m.csv")
    rows = {r["id"]: r for r in m.collect()}
    assert rows["A"]["title"] == "Act, 1970" and rows["A"]["filename"] == "The Act, 1970.pdf" and rows["B"]["year"] == rows["B"]["official_url"] == ""
    assert tuple(cp.manifest_summary(m).first()) == (2, 1, 1)
    (tmp_path / "files").mkdir()
    for n in ("the_act_1970.PDF", "T.pdf"):
        (tmp_path / "files" / n).write_bytes(n.encode())
    f = cp.files(spark, f"{tmp_path}/files")
    assert {r["filename"]: r["path"].split("/")[-1] for r in cp.locate(m, f).collect()} == {"The Act, 1970.pdf": "the_act_1970.PDF", "t.pdf": "T.pdf"}
    pages = cp.page_text(f, lambda b: [b.decode(), "", "two"] if b.startswith(b"the") else 1 / 0)
    texts = [r["text"] for r in cp.document_text(pages).orderBy("path").collect()]
    assert any(t.startswith("[unreadable") for t in texts) and "the_act_1970.PDF\n\ntwo" in texts
    assert cp.state(spark, f"{tmp_path}/none").count() == 0
    assert st.changed(f.select(F.col("name").alias("id"), "content_hash"), cp.state(spark, f"{tmp_path}/none")).count() == 2


def test_cache_replay(spark):
    rows = [("a", i, k) for i, k in enumerate("xyxzyxwx")] + [("b", i, "x") for i in range(3)]
    got = ca.replay(spark.createDataFrame(rows, "c string, n int, k string"), "c", "n", "k", 2).orderBy("c", "n").collect()
    assert [r["hit"] for r in got] == [False, False, True, False, False, False, False, True, False, True, True]


def test_recall_grows_with_k(spark):
    q = spark.createDataFrame([(i,) for i in range(8)], "query_id int")
    g = spark.createDataFrame([(i, i * 3 + 1) for i in range(6)], "query_id int, gold_rank int")
    r = mt.evaluated(q, g).agg(*mt.rates()).first()
    assert 0 < r["recall5"] <= r["recall10"] <= r["recall20"] < 1


def test_model_boundaries(spark):
    x = spark.createDataFrame([("a b", "b c", "en", "hi"), (None, "", "en", "en")], "q string, t string, s string, d string")
    y = x.select(models.embed(F.col("q")).alias("v"), models.cross_encode(F.col("q"), F.col("t")).alias("s"), models.translate(F.col("q"), F.col("s"), F.col("d"), lambda: lambda t, a, b: t.upper()).alias("tr"), models.complete(F.col("t"), lambda: [lambda p: 1 / 0, lambda p: f"<{p}>"]).alias("c")).collect()
    assert abs(sum(v * v for v in y[0]["v"]) - 1) < 1e-6 and len(y[1]["v"]) == models.DIMENSION and y[0]["s"] == 1 - 3 / 1000
    assert y[0]["tr"] == "A B" and y[1]["tr"] is None and [r["c"] for r in y] == ["<b c>", "<>"]
    assert models.is_rate_limit("Error 429") and not models.is_rate_limit("timeout")


def test_splitting_a_batch_holds_the_objects_of_some_texts_only(spark):
    import tracemalloc

    import pyarrow as pa
    from docweave.operators import chunk as ck

    texts = [f"{i} " + "words of a text " * 200 for i in range(4000)] + [None]
    split = ck._chunk_udf(lambda t, s: [("a", (t or "")[j:]) for j in (0, 1)]).func
    whole, strategy = pa.array(texts), pa.array(["section"] * len(texts))
    tracemalloc.start()
    got = split(whole, strategy)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[3999:] == [[{"section": "a", "text": texts[3999]}, {"section": "a", "text": texts[3999][1:]}], [{"section": "a", "text": ""}] * 2]
    assert len(got) == 4001 and peak < got.nbytes / 4
