from docweave.functions import fixed
from docweave.plans import service as sv
from docweave.sources import corpus as cp
from pyspark.sql import functions as F

ACT = "1. Short title of this Act which is long enough to be kept as a section of its own here.\n2. Turmeric and neem are plants whose extracts are known since long and not new at all in this country.\n3. What are not inventions: traditional knowledge, or what aggregates known properties of known components."
TREATY = "Article 1. Objectives\nThe objectives are the sharing of benefits from genetic resources in a fair way.\nArticle 2. Consent\nPrior informed consent of the party that provides the genetic resources is needed."


def manifest_rows():
    row = dict.fromkeys(cp.MANIFEST_COLUMNS, "")
    a = row | {"id": "N1", "title": "Patents Act, 1970", "jurisdiction": "National", "chunk_strategy": "section", "citation_prefix": "Section"}
    b = row | {"id": "I1", "title": "Nagoya Protocol", "jurisdiction": "International", "chunk_strategy": "article", "citation_prefix": "Article"}
    return [tuple(r[c] for c in cp.MANIFEST_COLUMNS) for r in (a, b)]


def prepared(spark):
    m = spark.createDataFrame(manifest_rows(), cp.MANIFEST)
    texts = spark.createDataFrame([("N1", ACT), ("I1", TREATY)], "id string, text string").withColumn("content_hash", F.sha2("text", 256))
    points = sv.ingest(m, texts, spark.createDataFrame([], cp.STATE)).cache()
    return m, texts, points


def test_ingest_only_what_changed(spark):
    m, texts, points = prepared(spark)
    assert {r["document_id"]: r["n"] for r in points.groupBy("document_id").agg(F.count("*").alias("n")).collect()} == {"N1": 3, "I1": 2}
    state = sv.ingest_state(points, "native", "2024-01-01")
    assert sv.ingest(m, texts, state).count() == 0
    changed = texts.withColumn("content_hash", F.when(F.col("id") == "I1", "x").otherwise(F.col("content_hash")))
    assert {r["document_id"] for r in sv.ingest(m, changed, state).collect()} == {"I1"}


def test_ask_and_compare(spark):
    _, _, points = prepared(spark)
    index = sv.build_index(points)
    rules = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate(fixed.EXPANSIONS)], "ord int, pattern string, expansion string")
    outcomes = spark.createDataFrame(fixed.ABS_OUTCOMES, "outcome string, authority boolean, board boolean, provision string")
    found = lambda q: sv.retrieve(q, points, index, rules)
    requests = spark.createDataFrame(
        [("1", "Is traditional knowledge of turmeric patentable?", "national", None, None), ("2", "What about neem?", "national", "Is turmeric known?", None), ("3", "I want to sell my oil", "national", None, None), ("4", "consent for genetic resources", "international", None, None), ("5", "anything", "mars", None, None)],
        "query_id string, query string, jurisdiction string, prior string, classification string",
    )
    got = {r["query_id"]: r for r in sv.ask(requests, found, outcomes).collect()}
    assert [got[i]["route"] for i in "12345"] == ["answer", "answer", "ask", "answer", "abstain"]
    assert got["1"]["answer"].startswith("According to [Patents Act, 1970]") and got["4"]["citations"][0]["source"] == "Nagoya Protocol"
    candidates = found(requests)
    assert candidates.join(requests.select("query_id", F.col("jurisdiction").alias("asked")), "query_id").where("jurisdiction <> asked").count() == 0
    assert {r["query_id"] for r in sv.diagnostics(candidates).collect()} == set("1234")
    both = sv.compare(requests.where("query_id in ('1', '4')"), lambda r: sv.ask(r, found, outcomes)).collect()
    assert len(both) == 2 and all(r["isolated"] for r in both)
