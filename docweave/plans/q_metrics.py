"""Retrieval quality on driver tables: benchmark items as questions, documents as the corpus, labels as relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contain
from ..operators import metrics as mt
from ..operators import rank as rk
from ..operators import rules as rl
from .q_rank import STATS, TOKENS, bm25_sql, docs, points, search_terms, words_sql
from .tables import sql_values, table, values

POOL = 20
DENSE = 30
KS = (1, 5, 10, 20)


def questions(spark, sf_dir):
    """Benchmark items, whole, as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("en").alias("jurisdiction"), (F.col("item_id") % 2 == 0).alias("exact"), F.concat(F.lit("domain "), F.col("item_id") % 5).alias("domain"))


def pool(spark, sf_dir):
    """The candidate pool of every question: BM25 over English documents."""
    return search_terms(spark, sf_dir, rk.query_terms(questions(spark, sf_dir)), POOL)


#: Candidates that may be broadcast to their texts; bounded by the number of questions, and beyond it joined by a shuffle.
MOST_CANDIDATES = 100_000


def candidates(spark, sf_dir, n, rows):
    """The n best documents of each question with their rows."""
    c = pool(spark, sf_dir).where(F.col("rank") <= n)
    few = table(spark, sf_dir, "benchmark").count() * n <= MOST_CANDIDATES
    return rows.join(F.broadcast(c) if few else c, "id")


def judged(spark, sf_dir):
    """Questions with the rank of the first document of quality 1 in their pool."""
    gold = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("gold"))
    x = pool(spark, sf_dir).join(gold, "id", "left")
    return mt.evaluated(questions(spark, sf_dir), mt.first_gold(x, F.col("gold")), KS)


def eval_metrics(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("exact").agg(*mt.rates(KS))


def eval_published(spark, sf_dir):
    """The benchmark's summary for each domain: gold is judged by title and section, answers are put together from the five
    documents on top, and a question's latency is that of the event with its number."""
    one = F.struct("rank", F.col("source").alias("title"), F.concat(F.lit("Section "), F.col("id")).alias("section"), "text")
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "text")
    top = candidates(spark, sf_dir, 5, d).select("query_id", one.alias("c")).select("query_id", "c.*")
    item = F.col("query_id")
    gold = questions(spark, sf_dir).select("query_id", F.concat(F.lit("SRC"), item % 3).alias("gold_doc"), F.array(F.concat(F.lit("section "), item % 5), F.lit("SECTION 9")).alias("gold_sections"))
    answers = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "section", "text"))).alias("chunks")).select("query_id", rl.template_answer(F.col("chunks")).alias("answer"))
    took = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), (F.col("value") * 100).alias("latency_ms"))
    q = questions(spark, sf_dir).select("query_id", "exact", "domain", (item % 4 == 3).alias("negative")).join(answers, "query_id", "left").join(took, "query_id", "left")
    rows = mt.benchmark(q, mt.judged(top, gold)).join(q.select("query_id", "domain"), "query_id")
    return mt.published(rows, "domain")


def contained_lines(spark, sf_dir):
    """The documents that hold a sentence of a benchmark item, whole."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.posexplode(F.split("text", r"(?<=\.)\s+")).alias("line", "text"))
    lines = lines.select(F.struct("item_id", "line").alias("at"), "text")
    found = contain.contained(docs(spark, sf_dir).select("doc_id", "text"), lines, "doc_id", "at")
    return found.select(F.col("whole").alias("doc_id"), F.col("part.item_id").alias("item_id"), F.col("part.line").cast("bigint").alias("line"))


def eval_by_domain(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("domain").agg(*mt.rates(KS))


def modes(spark, sf_dir):
    """Failure modes from three lists: dense neighbours of the vector with the question's number, the pool, and both fused."""
    vectors = points(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")).join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    sparse = pool(spark, sf_dir)
    near = rk.dense(points(spark, sf_dir), vectors, DENSE)
    gold = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    best = lambda x, rank: x.join(gold, "id", "left_semi").groupBy("query_id").agg(F.min(rank).alias(rank))
    lists = [best(near.withColumnRenamed("rank", "dense"), "dense"), best(sparse.withColumnRenamed("rank", "sparse"), "sparse"), best(rk.fuse(near, sparse).withColumnRenamed("rrf_rank", "fused"), "fused")]
    x = questions(spark, sf_dir).select("query_id", "exact")
    for one in lists:
        x = x.join(one, "query_id", "left")
    top = F.coalesce(F.col("sparse") <= 1, F.lit(False))
    return x.withColumn("mode", mt.failure_mode(F.col("exact"), F.col("dense"), F.col("sparse"), F.coalesce(F.col("fused") <= 8, F.lit(False)), top, F.lit(True)))


def failure_modes(spark, sf_dir):
    return mt.histogram(modes(spark, sf_dir), "mode")


#: Expressions by which the rows of a table run through all combinations of what a failure mode is told by.
SIGNS = ["exact", "dense", "sparse", "fused", "in_top", "cited"]


def _signs(div: str) -> str:
    """Of the arms the rank, of the others yes or no."""
    on = {n: f"(doc_id {div} {2**i}) % 2 = 0" for i, n in enumerate(SIGNS)}
    return ", ".join(f"{f'CASE WHEN {e} THEN 1 END' if n in ('dense', 'sparse') else e} AS {n}" for n, e in on.items())


def failure_table(spark, sf_dir):
    x = table(spark, sf_dir, "documents").selectExpr("doc_id", *_signs("div").split(", "))
    return x.withColumn("mode", mt.failure_mode(*(F.col(c) for c in SIGNS)))


QUESTIONS = [(1, "idiot moron worthless"), (2, "zzzz qqqq"), (3, "the of and")]


def abstention(spark, sf_dir):
    """Questions with nothing found at all, and those whose best score is under the threshold of confidence."""
    q = values(spark, [(i, t, None) for i, t in QUESTIONS], "query_id int, query string, jurisdiction string")
    terms = rk.query_terms(q)
    hits = search_terms(spark, sf_dir, terms, 5)
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    x = q.join(best, "query_id", "left")
    return x.select("query_id", F.col("best").isNull().alias("abstained"), rl.confidence(F.col("best")).alias("unsure"), F.round("best", 6).alias("best"))


def chunks(spark, sf_dir):
    """The best documents of each question as an ordered array of chunks."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "text")
    x = candidates(spark, sf_dir, 5, d)
    one = F.struct("rank", F.col("source").alias("title"), F.concat(F.lit("Section "), F.col("id")).alias("section"), "text", "score")
    return x.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("chunks"))


def context_assembly(spark, sf_dir):
    c = chunks(spark, sf_dir).select("query_id", rl.context_block(F.col("chunks")).alias("context"))
    return c.select("query_id", F.length("context").cast("bigint").alias("n_chars"), F.md5("context").alias("digest"))


def template_answer(spark, sf_dir):
    return chunks(spark, sf_dir).select("query_id", rl.template_answer(F.col("chunks")).alias("answer"))


def ranked_tiers(spark, sf_dir):
    """The first six candidates with score, clipped percentage, tier, use and snippet."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    x = candidates(spark, sf_dir, 6, d).withColumn("score", F.round(F.col("score") / 40, 6))
    s = F.col("score")
    return x.select("query_id", "id", "rank", "score", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), s * 100)), 6).alias("percentage"), rl.relevance_tier(s).alias("tier"), (F.col("rank") <= 4).alias("used"), tx.truncated(F.col("text"), 180, 180).alias("snippet"))


_NAMES = "eval_metrics eval_published contained_lines eval_by_domain failure_modes failure_table abstention context_assembly template_answer ranked_tiers".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TERMS = f"SELECT item_id AS query_id, unnest({words_sql('text')}) AS term FROM benchmark"
_POOL = f"WITH {TOKENS}, {STATS}, {bm25_sql(_TERMS, POOL, 'all_hits')}, pool AS (SELECT * FROM all_hits WHERE jurisdiction = 'en')"
_JUDGED = f"""{_POOL}, gold AS (SELECT query_id, min(rank) AS gold_rank FROM pool JOIN labels ON id = doc_id WHERE quality = 1 GROUP BY 1),
judged AS (SELECT item_id AS query_id, item_id % 2 = 0 AS exact, 'domain ' || (item_id % 5) AS domain, gold_rank, coalesce(1.0 / gold_rank, 0) AS rr FROM benchmark LEFT JOIN gold ON query_id = item_id)"""
_RATES = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN gold_rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall{k}" for k in KS) + ", round(avg(rr), 6) AS mrr"
_MODE = """CASE WHEN in_top THEN 'NONE' WHEN dense IS NULL AND sparse IS NULL AND exact THEN 'A. Chunking problem' WHEN dense IS NULL AND sparse IS NULL THEN 'G. Query expansion problem' WHEN dense IS NULL THEN 'C. Dense retrieval problem'
    WHEN sparse IS NULL THEN 'D. BM25 problem' WHEN fused THEN 'F. CrossEncoder reranking problem' ELSE 'E. RRF fusion problem' END"""
_CHUNKS = f"{_POOL}, c AS (SELECT query_id, rank, source AS title, 'Section ' || id AS section, text FROM pool JOIN documents ON doc_id = id WHERE rank <= 5)"
_CITE = "'[' || title || '] ' || section"
ORACLE = {
    "eval_metrics": f"{_JUDGED} SELECT exact, {_RATES} FROM judged GROUP BY 1",
    "eval_published": f"""{_CHUNKS}, t AS (SELECT c.*, contains(lower(title), 'src' || (query_id % 3)) AND (contains(lower(section), 'section ' || (query_id % 5)) OR contains(lower(section), 'section 9')) AS gold FROM c),
        g AS (SELECT query_id, min(rank) FILTER (gold) AS gold_rank, count(*) - count(DISTINCT coalesce(text, '')) AS duplicates, list({_CITE} ORDER BY rank) AS cites, arg_min(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), rank) AS lead FROM t GROUP BY 1),
        a AS (SELECT *, 'according to ' || lower(cites[1] || CASE WHEN length(lead) > 300 THEN left(lead, 297) ELSE lead END || array_to_string(cites[2:3], ', ')) || ' additional applicable authorities include: none' AS said FROM g),
        r AS (SELECT item_id AS query_id, item_id % 2 = 0 AS exact, 'domain ' || (item_id % 5) AS domain, item_id % 4 = 3 AS negative, gold_rank, gold_rank IS NOT NULL AS hit, coalesce(duplicates, 0) AS duplicates, value * 100 AS latency_ms,
            contains(coalesce(said, ''), 'not') OR contains(coalesce(said, ''), 'cannot') OR contains(coalesce(said, ''), 'prohibit') OR contains(coalesce(said, ''), 'can be') AS denied FROM benchmark LEFT JOIN a ON query_id = item_id LEFT JOIN events ON event_id = item_id)
        SELECT domain, count(*) AS n, count(*) FILTER (hit) AS n_hit, round(avg(hit::INT), 6) AS recall5, round(avg(coalesce(1.0 / gold_rank, 0)), 6) AS mrr, round(avg(hit::INT) FILTER (exact), 6) AS exact_recall5, round(avg(hit::INT) FILTER (NOT exact), 6) AS paraphrased_recall5,
            count(*) FILTER (negative) AS n_negative, round(avg((hit OR denied)::INT) FILTER (negative), 6) AS negative_correct, round(avg(hit::INT), 6) AS citation_accuracy, sum(duplicates)::BIGINT AS duplicates, round(avg(latency_ms), 6) AS mean_latency_ms FROM r GROUP BY 1""",
    "contained_lines": r"""WITH l AS (SELECT item_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS line FROM (SELECT item_id, string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1)) AS w FROM benchmark))
        SELECT doc_id, item_id, line FROM l JOIN documents d ON contains(d.text, l.text) WHERE trim(l.text) <> ''""",
    "eval_by_domain": f"{_JUDGED} SELECT domain, {_RATES} FROM judged GROUP BY 1",
    "failure_modes": f"""{_POOL}, q AS (SELECT item_id AS query_id, item_id % 2 = 0 AS exact FROM benchmark), gold AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1),
        near AS (SELECT * FROM (SELECT query_id, p.vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(p.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, p.vec_id) AS rank FROM q JOIN embeddings v ON v.vec_id = query_id, embeddings p) WHERE rank <= {DENSE}),
        both_arms AS (SELECT coalesce(n.query_id, s.query_id) AS query_id, coalesce(n.id, s.id) AS id, n.rank AS dense_rank, s.rank AS bm25_rank, round(coalesce(1.0 / (60 + n.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS rrf FROM near n FULL JOIN pool s ON n.id = s.id AND n.query_id = s.query_id),
        fused_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, id) AS rank FROM both_arms),
        d AS (SELECT query_id, min(rank) AS dense FROM near JOIN gold USING (id) GROUP BY 1), s AS (SELECT query_id, min(rank) AS sparse FROM pool JOIN gold USING (id) GROUP BY 1), f AS (SELECT query_id, min(rank) AS fr FROM fused_list JOIN gold USING (id) WHERE rank <= 25 GROUP BY 1),
        m AS (SELECT {_MODE} AS mode FROM (SELECT *, coalesce(fr <= 8, false) AS fused, coalesce(sparse <= 1, false) AS in_top FROM q LEFT JOIN d USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN f USING (query_id)))
        SELECT mode, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM m GROUP BY 1""",
    "failure_table": f"SELECT *, {_MODE} AS mode FROM (SELECT doc_id, {_signs('//')} FROM documents)",
    "abstention": f"WITH {TOKENS}, {STATS}, q AS (SELECT * FROM {sql_values(QUESTIONS, 'q', 'query_id, query')}), {bm25_sql('SELECT query_id, unnest(' + words_sql('query') + ') AS term FROM q', 5)}, b AS (SELECT query_id, max(score) AS best FROM hits GROUP BY 1) SELECT query_id, best IS NULL AS abstained, best IS NULL OR best < 0.3 AS unsure, round(best, 6) AS best FROM q LEFT JOIN b USING (query_id)",
    "context_assembly": f"{_CHUNKS} SELECT query_id, length(k) AS n_chars, md5(k) AS digest FROM (SELECT query_id, string_agg('Source [' || rank || '] (' || {_CITE} || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS k FROM c GROUP BY 1)",
    "template_answer": rf"""{_CHUNKS}, g AS (SELECT query_id, list({_CITE} ORDER BY rank) AS cites, arg_min(regexp_replace(text, '^\s+|\s+$', '', 'g'), rank) AS lead FROM c GROUP BY 1)
        SELECT query_id, 'According to ' || cites[1] || ':' || chr(10) || '"' || CASE WHEN length(lead) > 300 THEN left(lead, 297) || '...' ELSE lead END || '"' || chr(10) || chr(10) || 'Additional applicable authorities include: ' || CASE WHEN len(cites) > 1 THEN array_to_string(cites[2:3], ', ') ELSE 'None' END || '.' AS answer FROM g""",
    "ranked_tiers": f"""{_POOL} SELECT query_id, id, rank, s AS score, round(least(100.0, greatest(0.0, s * 100)), 6) AS percentage, CASE WHEN s >= 0.8 THEN 'Critical Statutory Grounding' WHEN s >= 0.4 THEN 'High Statutory Relevance' ELSE 'Contextual Legal Anchor' END AS tier, rank <= 4 AS used,
        CASE WHEN length(text) > 180 THEN left(text, 180) || '...' ELSE text END AS snippet FROM (SELECT *, round(score / 40, 6) AS s FROM pool) JOIN documents ON doc_id = id WHERE rank <= 6""",
}
