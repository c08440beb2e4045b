from docweave.functions import fixed
from docweave.functions import text as tx
from docweave.operators import rules as r
from pyspark.sql import functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_abs_trigger(spark):
    cases = [
        ("I want to export a herbal supplement made from a plant sourced in Kerala — what approval do I need?", True),
        ("What are the ABS obligations for commercializing ashwagandha from Madhya Pradesh?", True),
        ("State Biodiversity Board intimation rules under the BD Act", True),
        ("What is Section 3(p) of the Patents Act?", False),
        ("Can a software algorithm be patented in India?", False),
        ("a goal for a leaf", True),
    ]
    got = spark.createDataFrame(cases, "q string, want boolean").select(r.abs_trigger(F.col("q")).alias("got"), "want").collect()
    assert all(x["got"] == x["want"] for x in got)


def test_tkdl_trigger_follows_the_definition(spark):
    cases = [
        ("My grandmother gave me a family recipe for a herbal joint pain oil made from classical Ayurvedic texts — can I patent it?", None, True),
        ("We want to formulate a new oil using sesame and ginger for arthritis.", "classical_medicine", False),
        ("Can I patent a software algorithm for inventory management?", None, False),
        ("What are the requirements for trademark registration in Class 5?", None, False),
        ("How do patent examiners use TKDL to check prior art for traditional formulations?", None, True),
        ("Is turmeric patentable under Section 3(p)?", None, False),
        (None, None, False),
    ]
    got = spark.createDataFrame(cases, "q string, c string, want boolean").select(r.tkdl_trigger(F.col("q"), F.col("c")).alias("got"), "want").collect()
    assert [x["got"] for x in got] == [x["want"] for x in got]
    h = r.tkdl_hints(F.col("q"))
    x = spark.createDataFrame(cases[:1], "q string, c string, want boolean").select(*(c.alias(n) for n, c in h.items())).first()
    assert x["preparation"].startswith("Taila Kalpana") and "Sandhivata" in x["area"] and {"A61K 36/00", "A61P 19/02"} <= set(x["classes"]) and x["source_texts"][2] == fixed.OIL_TEXT


def test_intent(spark):
    assert one(spark, r.intent(F.col("q")), q="I want to sell my grandmother's Ayurvedic oil recipe, what IP protection do I need?")
    assert not one(spark, r.intent(F.col("q")), q="What does Section 3(p) of the Patents Act prohibit?")


def test_abs_outcomes_and_flow(spark):
    rows = [(False, None, None, False, False), (True, True, False, False, True), (True, True, True, True, False), (True, False, False, False, False), (True, False, True, True, False), (True, None, True, False, True), (None, True, False, False, True)]
    table = {o: (a, b) for o, a, b, _ in fixed.ABS_OUTCOMES}
    x = spark.createDataFrame(rows, "i boolean, c boolean, f boolean, nba boolean, sbb boolean").select(r.abs_outcome(F.col("i"), F.col("c"), F.col("f")).alias("o"), "nba", "sbb").collect()
    assert all(table[y["o"]] == (y["nba"], y["sbb"]) for y in x)
    q = "I want to export a herbal supplement made from a plant sourced in Kerala — what approval do I need?"
    flow = spark.createDataFrame([(1, q, None), (2, q, False), (3, "nothing", None)], "id int, query string, is_foreign_entity boolean").selectExpr("*", "cast(null as boolean) as is_sourced_from_india", "cast(null as boolean) as is_commercial_use")
    outcomes = spark.createDataFrame(fixed.ABS_OUTCOMES, "outcome string, authority boolean, board boolean, provision string")
    got = {y["id"]: y for y in r.abs_flow(flow, outcomes).collect()}
    assert (got[1]["status"], got[1]["next_question"], got[1]["state"]) == ("needs_input", "is_foreign_entity", "Kerala")
    assert (got[2]["status"], got[2]["outcome"]) == ("completed", "domestic_commercial")
    assert (got[3]["status"], got[3]["outcome"]) == ("not_triggered", None)


def test_text_functions(spark):
    assert one(spark, tx.clean_text(F.col("t")), t="Page 1 of 2\r\n a \t b \n\n\n\nc\n 7 \n") == "a b\n\nc"
    assert one(spark, tx.normalize_citations(F.col("t")), t="sec 3(p), rule 158-B") == "Section 3(p), Rule 158B"
    damaged, kept = (one(spark, tx.normalize_citations(F.col("t"), strict), t="the Patents Act 1970 and 2023 amendment") for strict in (False, True))
    assert damaged == "the Patents Act Rule 1970and Rule 2023amendment" and kept == "the Patents Act 1970 and 2023 amendment"
    import uuid

    for name in ("IND-PAT-001_0", "ü", ""):
        assert one(spark, tx.uuid5(tx.DNS, F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, tx.detect_language(F.col("t")), t="क") == "hi" and one(spark, tx.detect_language(F.col("t")), t="x") == "en"
    p = one(spark, tx.parse_answer(F.col("t")), t='x {"answer": "a", "citations": []} y')
    assert p["answer"] == "a"


def test_legal_tokens(spark):
    got = one(spark, tx.legal_tokens(F.col("t")), t="Section 2(1)(ja) rule 158-B art. 6")
    for token in ("section 2(1)(ja)", "(ja)", "section 2", "rule 158b", "158-b", "article 6", "article6", "art 6", "2(1)(ja)", "art"):
        assert token in got, token
