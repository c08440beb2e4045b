"""Index and ranking queries on the driver's tables.

documents: text, lang as partition, source as title, doc_id as id. embeddings: vec_id as id, label as category. That
doc_id and vec_id name the same thing in the hybrid queries is a convention of ours.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import legal_tokens, rerank_text, searchable, sigmoid, statutory_tokens, uuid5, DNS, words
from ..operators import ann as an
from ..operators import index as ix
from ..operators import postings as ps
from ..operators import rank as rk
from .tables import literal, publish, shared_dir, table, values, version

QUERY = "the heing tioned para que elle der lich idiot moron"
EXPANDED = QUERY + " worthless pathetic stupid license"
LETTERS = "a b c d e f g h i j k l m n o p".split()


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\s()]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2 OR list_contains({literal(LETTERS)}, w))"


BODY_SQL = "(coalesce(source, '') || ' ' || coalesce(lang, '') || '  ' || coalesce(text, ''))"
TOKENS = f"tok AS (SELECT lower(lang) AS jurisdiction, doc_id AS id, {words_sql(BODY_SQL)} AS tokens FROM documents), len AS (SELECT *, len(tokens) AS length FROM tok)"
STATS = "stats AS (SELECT jurisdiction, count(*) AS n, avg(length) AS avg_length FROM len GROUP BY jurisdiction)"


def bm25_sql(terms: str, k: int = 20, name: str = "hits") -> str:
    """CTEs that end in `name`(query_id, jurisdiction, id, score, rank), for a query giving (query_id, term)."""
    return f"""
{name}_terms AS (SELECT DISTINCT query_id, term FROM ({terms})),
{name}_tf AS (SELECT jurisdiction, id, length, term, count(*) AS tf FROM (SELECT jurisdiction, id, length, unnest(tokens) AS term FROM len) WHERE term IN (SELECT term FROM {name}_terms) GROUP BY ALL),
{name}_df AS (SELECT jurisdiction, term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_scored AS (
    SELECT query_id, jurisdiction, id, round(sum(greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 0.001) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * CASE WHEN avg_length > 0 THEN length / avg_length ELSE 0 END))), 9) AS score
    FROM {name}_tf JOIN {name}_terms USING (term) JOIN {name}_df USING (jurisdiction, term) JOIN stats USING (jurisdiction) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, jurisdiction ORDER BY score DESC, id) AS rank FROM {name}_scored WHERE score > 0) WHERE rank <= {k})"""


def literal_terms(query: str, query_id: int = 1) -> str:
    return f"SELECT {query_id} AS query_id, unnest({words_sql(literal(query))}) AS term"


DENSE = "SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 9) AS score{more} FROM embeddings"


def dense_sql(k: int, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT 1 AS query_id, *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({DENSE.format(more='')} WHERE {where})) WHERE rank <= {k}"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def queries(spark, *texts, jurisdiction=None):
    return values(spark, [(i, t, jurisdiction) for i, t in enumerate(texts, 1)], "query_id int, query string, jurisdiction string")


def bodies(spark, sf_dir):
    """Documents with what is searched: title, prefix, section and text; documents have no sections."""
    return docs(spark, sf_dir).select("doc_id", "lang", searchable(F.col("source"), F.col("lang"), F.lit(None), F.col("text")).alias("body"))


def index_path(spark, sf_dir) -> str:
    return f"{shared_dir(spark)}/docweave-index/{ps.FORMAT}-{version(spark, f'{sf_dir}/documents.parquet')}"


def stored_index(spark, sf_dir) -> ps.Postings:
    """The index of these documents from the shared folder, written there if there is none.

    It is named by the documents' files, so that other or changed ones have one of their own, and written under another
    name before, so that no query finds one that is not whole.
    """
    path = index_path(spark, sf_dir)
    found = ps.stored(spark, path)
    if found is None:
        own = f"{path}-{uuid.uuid4().hex}"
        ps.create(own, bodies(spark, sf_dir), "doc_id", "lang", "body")
        publish(spark, own, path)
        found = ps.load(spark, path)
    return found


def search_terms(spark, sf_dir, terms, k=20):
    """BM25 over the stored index if there is one, and else over the texts: an index of all terms costs a hundred times what a
    question shuffles and writes, so that a query that happens to come first does not pay for it."""
    index = ps.stored(spark, index_path(spark, sf_dir))
    if index is None:
        found = ps.scan(bodies(spark, sf_dir), "doc_id", "lang", "body", terms, f"{shared_dir(spark)}/docweave-index/scan-{uuid.uuid4().hex}", k)
        if found is not None:
            return found
    return ps.search(index or stored_index(spark, sf_dir), terms, k)


def search(spark, sf_dir, query=QUERY, k=20, jurisdiction=None):
    """BM25 of one literal query."""
    return search_terms(spark, sf_dir, rk.query_terms(queries(spark, query, jurisdiction=jurisdiction)), k)


def bm25_topk(spark, sf_dir):
    return search(spark, sf_dir).select("jurisdiction", "id", F.round("score", 6).alias("score"), "rank")


def bm25_tf(spark, sf_dir):
    t = ix.tokens(bodies(spark, sf_dir), "doc_id", "lang", "body")
    return ix.term_frequencies(t).select("jurisdiction", "id", "term", "tf")


def bm25_df(spark, sf_dir):
    t = ix.tokens(bodies(spark, sf_dir), "doc_id", "lang", "body")
    return ix.document_frequencies(ix.term_frequencies(t))


def bm25_stats(spark, sf_dir):
    t = ix.tokens(bodies(spark, sf_dir), "doc_id", "lang", "body")
    return ix.statistics(t).select("jurisdiction", "n", F.round("avg_length", 6).alias("avg_length"))


def bm25_two_query_merge(spark, sf_dir):
    both = search_terms(spark, sf_dir, rk.query_terms(queries(spark, QUERY, EXPANDED)))
    first, second = (both.where(F.col("query_id") == i).withColumn("query_id", F.lit(1)) for i in (1, 2))
    m = rk.merge_two(first, second)
    return m.select("jurisdiction", "id", F.round("score", 6).alias("score"), "rank")


def bm25_cache_parity(spark, sf_dir):
    """Hits with their scores from an index made anew and from the stored one."""
    terms = rk.query_terms(queries(spark, QUERY))
    fresh = ix.build(bodies(spark, sf_dir), "doc_id", "lang", "body", terms.select("term"))
    both = (rk.bm25(fresh, terms), "score"), (ps.search(stored_index(spark, sf_dir), terms), "stored_score")
    a, b = (x.select("jurisdiction", "id", "rank", F.round("score", 6).alias(c)) for x, c in both)
    return a.join(b, ["jurisdiction", "id", "rank"], "full")


def bm25_incremental(spark, sf_dir):
    """The hits over an index that has followed its documents: at first every seventh had another text and was of another
    language, every eleventh was not there, and others were that are gone now."""
    path = f"{shared_dir(spark)}/docweave-index/incremental-{uuid.uuid4().hex}"
    now = bodies(spark, sf_dir)
    changed, added = F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 1
    draft = now.where(changed).select("doc_id", F.lit("en").alias("lang"), F.concat(F.lit("worthless draft of "), F.reverse("body")).alias("body"))
    extra = now.where("doc_id % 13 = 2").select((-F.col("doc_id")).alias("doc_id"), "lang", "body")
    ps.create(path, now.where(~changed & ~added).unionByName(draft.where(~added)).unionByName(extra), "doc_id", "lang", "body")
    ps.append(path, now.where(added), extra, "doc_id", "lang", "body")
    index = ps.append(path, now.where(changed & ~added), draft.where(~added), "doc_id", "lang", "body")
    return ps.search(index, rk.query_terms(queries(spark, QUERY))).select("jurisdiction", "id", F.round("score", 6).alias("score"), "rank")


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def first_vector(spark, sf_dir):
    return points(spark, sf_dir).where("id = 0").select(F.lit(1).alias("query_id"), F.col("embedding").alias("vector"))


def dense_topk(spark, sf_dir):
    d = rk.dense(points(spark, sf_dir), first_vector(spark, sf_dir))
    return d.select("id", F.round("score", 6).alias("score"), "rank")


def dense_topk_filtered(spark, sf_dir):
    d = rk.dense(points(spark, sf_dir), first_vector(spark, sf_dir), where=F.col("label") == 3)
    return d.select("id", F.round("score", 6).alias("score"), "rank")


def dense_approximate(spark, sf_dir):
    """The neighbours of every hundredth vector through an index of codes, each question with its recall of the exact list
    and the share of all vectors that were scored exactly for it."""
    p = points(spark, sf_dir)
    q = p.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = an.build(p.select("id", "embedding"), f"{shared_dir(spark)}/docweave-index/vectors-{uuid.uuid4().hex}")
    found = an.search(index, q)
    scored = an.candidates(index, q).groupBy("query_id").agg(F.count("*").alias("scored")).crossJoin(F.broadcast(p.agg(F.count("*").alias("n"))))
    x = found.join(an.recall(found, rk.dense(p, q)), "query_id").join(scored, "query_id")
    return x.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "recall", F.round(F.col("scored") / F.col("n"), 6).alias("share_scored"))


def fused(spark, sf_dir):
    sparse = search(spark, sf_dir, jurisdiction="en")
    return rk.fuse(rk.dense(points(spark, sf_dir), first_vector(spark, sf_dir)), sparse)


FUSED = f"""WITH {TOKENS}, {STATS}, {bm25_sql(literal_terms(QUERY), name='sparse0')},
sparse AS (SELECT * FROM sparse0 WHERE jurisdiction = 'en'), dense AS ({dense_sql(30)}),
both_arms AS (
    SELECT coalesce(d.id, s.id) AS id, d.rank AS dense_rank, s.rank AS bm25_rank, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS rrf_score
    FROM dense d FULL JOIN sparse s ON d.id = s.id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, id) AS rrf_rank FROM both_arms) WHERE rrf_rank <= 25)"""


def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("id", "dense_rank", "bm25_rank", F.round("rrf_score", 6).alias("rrf_score"), "rrf_rank")


def with_text(spark, sf_dir, candidates):
    """Texts are joined after the cut, never before. One query has 25 candidates at most, so that they are broadcast and
    the texts are not shuffled."""
    return docs(spark, sf_dir).withColumnRenamed("doc_id", "id").join(F.broadcast(candidates), "id")


def diversified_topk(spark, sf_dir):
    x = with_text(spark, sf_dir, fused(spark, sf_dir))
    return rk.diversify(x, "source", "rrf_rank").select("id", "source", "rrf_rank", "position")


def stand_in_score(query, text):
    """A deterministic stand-in for a cross-encoder: shared terms less a penalty for length."""
    return F.size(F.array_intersect(F.array_distinct(words(query)), words(text))) - F.length(text) / 1000.0


def pairs(spark, sf_dir):
    x = with_text(spark, sf_dir, fused(spark, sf_dir))
    return x.withColumn("pair", rerank_text(F.col("source"), F.col("lang"), F.lit("S"), F.col("text")))


PAIRS = f"{FUSED}, pairs AS (SELECT f.*, source, left(coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || 'S' || ': ' || coalesce(text, ''), 750) AS pair FROM fused f JOIN documents ON doc_id = id)"
SCORED = f"{PAIRS}, scored AS (SELECT *, len(list_intersect(list_distinct({words_sql(literal(QUERY))}), {words_sql('pair')})) - length(pair) / 1000.0 AS raw FROM pairs)"


def rerank_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", "rrf_rank", "pair", F.length("pair").cast("bigint").alias("pair_chars"))


def reranked(spark, sf_dir):
    x = pairs(spark, sf_dir).withColumn("raw", F.round(stand_in_score(F.lit(QUERY), F.col("pair")), 9))
    return rk.rerank(x, "raw")


def rerank_topk(spark, sf_dir):
    x = rk.diversify(reranked(spark, sf_dir), "source", "rerank_rank")
    return x.select("id", "source", F.round("raw", 6).alias("raw"), "rerank_rank", "position")


def sigmoid_calibration(spark, sf_dir):
    return reranked(spark, sf_dir).select("id", F.round(sigmoid(F.col("raw")), 6).alias("score"), "rerank_rank")


def neighbours(spark, sf_dir):
    hit = F.col("text").contains("idiot")
    return rk.neighbours(docs(spark, sf_dir), "lang", "doc_id", hit).select("lang", "doc_id", "target")


def rank_then_filter(spark, sf_dir):
    ranked = rk.dense(points(spark, sf_dir), first_vector(spark, sf_dir), k=50)
    labelled = ranked.join(points(spark, sf_dir).select("id", "label"), "id")
    return rk.entry_rank(labelled, F.col("label") == 3, [20, 25, 30, 50])


def isolation_check(spark, sf_dir):
    """Of the hits of a search within English, how many have which language; any other one is a leak."""
    found = search(spark, sf_dir, jurisdiction="en").select("id").join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lower("lang").alias("lang")), "id")
    return found.groupBy("lang").agg(F.count("*").alias("n"), (F.col("lang") != "en").alias("leak"))


def tokenize_words(spark, sf_dir):
    w = words(F.coalesce(F.col("text"), F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), F.md5(F.array_join(w, " ")).alias("digest"))


CITATIONS = [(1, "Section 3(p) and 2(1)(ja) of the Act"), (2, "Rule 158-B, rule 158 b; Article 27, art. 6a"), (3, "33-EEC and 12 days after 3 (d)"), (4, "nothing here"), (5, "Élan 3(é) SECTION 2 (1) (j)")]


def tokenize_statutory(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    both = d.unionByName(values(spark, [(-i, t) for i, t in CITATIONS], "id bigint, text string"))
    t = statutory_tokens(F.coalesce(F.col("text"), F.lit("")))
    return both.select("id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


def _family_sql(pattern: str, groups: int, forms: list[str]) -> str:
    zipped = ", ".join(f"regexp_extract_all(t, '{pattern}', {g})" for g in range(1, groups + 1))
    cols = ", ".join(forms)
    return f"flatten(list_transform(list_zip({zipped}{', []' if groups == 1 else ''}), lambda x: [{cols}]))"


STATUTORY = "list_concat({})".format(
    ", ".join(
        [
            _family_sql(r"(?:section\s*)?(\d+)\s*\(([0-9]+)\)\s*\(([a-z0-9]+)\)", 3, ["'section '||x[1]||'('||x[2]||')('||x[3]||')'", "x[1]||'('||x[2]||')('||x[3]||')'", "'section '||x[1]||'('||x[2]||')'", "x[1]||'('||x[2]||')'", "'('||x[3]||')'", "x[3]"]),
            _family_sql(r"(?:section\s*)?(\d+)\s*\(([a-z0-9]+)\)", 2, ["'section '||x[1]||'('||x[2]||')'", "x[1]||'('||x[2]||')'", "'section '||x[1]", "'('||x[2]||')'", "x[2]"]),
            "flatten(list_transform(regexp_extract_all(t, '(?:article|art\\.?)\\s*(\\d+[a-z]?)', 1), lambda x: ['article '||x, 'article'||x, 'art '||x]))",
            _family_sql(r"(?:rule\s*)?(\d+)\s*[-_ ]\s*([a-z0-9]+)", 2, ["'rule '||x[1]||x[2]", "x[1]||x[2]", "x[1]||'-'||x[2]"]),
            _family_sql(r"\b(\d+)\s*[-_]\s*([a-z]+)\b", 2, ["x[1]||x[2]", "x[1]||'-'||x[2]"]),
        ]
    )
)


def uuid5_ids(spark, sf_dir):
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", uuid5(DNS, name).alias("uuid"))


def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


def hybrid_retrieval(spark, sf_dir):
    """The whole path: dense and sparse lists, fusion, rerank, diversity."""
    x = reranked(spark, sf_dir)
    return rk.diversify(x, "source", "rerank_rank").select("id", "source", "dense_rank", "bm25_rank", "rrf_rank", "rerank_rank", F.round(sigmoid(F.col("raw")), 6).alias("score"), "position")


def legal_search(spark, sf_dir):
    """BM25 over citation-aware tokens."""
    d = docs(spark, sf_dir).select("doc_id", "lang", "text").unionByName(values(spark, [(-i, "en", t) for i, t in CITATIONS], "doc_id bigint, lang string, text string"))
    q = queries(spark, "Section 3(p) Rule 158B")
    terms = rk.query_terms(q, tokenizer=legal_tokens)
    place = f"{shared_dir(spark)}/docweave-index/legal-{uuid.uuid4().hex}"
    return rk.bm25(ix.build(d, "doc_id", "lang", "text", terms.select("term"), legal_tokens, place), terms, 10).select("id", "jurisdiction", F.round("score", 6).alias("score"), "rank")


_NAMES = """bm25_topk bm25_tf bm25_df bm25_stats bm25_two_query_merge bm25_cache_parity bm25_incremental dense_approximate dense_topk dense_topk_filtered rrf_fusion diversified_topk rerank_pairs
rerank_topk sigmoid_calibration neighbours rank_then_filter isolation_check tokenize_words tokenize_statutory uuid5_ids content_hash hybrid_retrieval legal_search""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_BM25 = f"WITH {TOKENS}, {STATS}, {bm25_sql(literal_terms(QUERY))}"
_DIVERSE = "SELECT *, row_number() OVER (ORDER BY nth > 3, {rank}) AS position FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {rank}) AS nth FROM {of})"
_RANKED = f"{SCORED}, reranked AS (SELECT *, row_number() OVER (ORDER BY round(raw, 9) DESC, id) AS rerank_rank FROM scored)"
ORACLE = {
    "bm25_topk": f"{_BM25} SELECT jurisdiction, id, round(score, 6) AS score, rank FROM hits",
    "bm25_incremental": f"{_BM25} SELECT jurisdiction, id, round(score, 6) AS score, rank FROM hits",
    "bm25_tf": f"WITH {TOKENS} SELECT jurisdiction, id, term, count(*) AS tf FROM (SELECT jurisdiction, id, unnest(tokens) AS term FROM tok) GROUP BY ALL",
    "bm25_df": f"WITH {TOKENS} SELECT jurisdiction, term, count(DISTINCT id) AS df FROM (SELECT jurisdiction, id, unnest(tokens) AS term FROM tok) GROUP BY ALL",
    "bm25_stats": f"WITH {TOKENS}, {STATS} SELECT jurisdiction, n, round(avg_length, 6) AS avg_length FROM stats",
    "bm25_two_query_merge": f"""WITH {TOKENS}, {STATS}, {bm25_sql(literal_terms(QUERY), name='a')}, {bm25_sql(literal_terms(EXPANDED), name='b')},
        new AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY rank) AS r FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = b.id AND a.jurisdiction = b.jurisdiction)),
        n1 AS (SELECT jurisdiction, count(*) AS n1 FROM a GROUP BY 1)
        SELECT jurisdiction, id, round(score, 6) AS score, rank FROM a
        UNION ALL SELECT jurisdiction, id, round(score, 6), coalesce(n1, 0) + r FROM new LEFT JOIN n1 USING (jurisdiction)""",
    "bm25_cache_parity": f"{_BM25} SELECT jurisdiction, id, rank, round(score, 6) AS score, round(score, 6) AS stored_score FROM hits",
    "dense_topk": f"SELECT id, round(score, 6) AS score, rank FROM ({dense_sql(30)})",
    "dense_topk_filtered": f"SELECT id, round(score, 6) AS score, rank FROM ({dense_sql(30, 'label = 3')})",
    "rrf_fusion": f"{FUSED} SELECT id, dense_rank, bm25_rank, round(rrf_score, 6) AS rrf_score, rrf_rank FROM fused",
    "diversified_topk": f"{PAIRS} SELECT id, source, rrf_rank, position FROM ({_DIVERSE.format(rank='rrf_rank', of='pairs')}) WHERE position <= 5",
    "rerank_pairs": f"{PAIRS} SELECT id, rrf_rank, pair, length(pair) AS pair_chars FROM pairs",
    "rerank_topk": f"{_RANKED} SELECT id, source, round(raw, 6) AS raw, rerank_rank, position FROM ({_DIVERSE.format(rank='rerank_rank', of='reranked')}) WHERE position <= 5",
    "sigmoid_calibration": f"{_RANKED} SELECT id, round(1 / (1 + exp(-raw)), 6) AS score, rerank_rank FROM reranked",
    "neighbours": "WITH t AS (SELECT lang, min(doc_id) AS target FROM documents WHERE contains(text, 'idiot') GROUP BY lang) SELECT lang, doc_id, target FROM documents JOIN t USING (lang) WHERE abs(doc_id - target) <= 2",
    "rank_then_filter": f"WITH r AS (SELECT r.*, label FROM ({dense_sql(50)}) r JOIN embeddings ON vec_id = id), p AS (SELECT unnest([20, 25, 30, 50]) AS pool) SELECT pool, min(rank) AS entry FROM p LEFT JOIN r ON rank <= pool AND label = 3 GROUP BY pool",
    "isolation_check": f"{_BM25} SELECT lower(lang) AS lang, count(*) AS n, lower(lang) <> 'en' AS leak FROM hits JOIN documents ON doc_id = id WHERE jurisdiction = 'en' GROUP BY 1",
    "tokenize_words": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)",
    "tokenize_statutory": f"WITH d AS (SELECT doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({-i}, lower({literal(t)}))' for i, t in CITATIONS)})) SELECT id, len(k) AS n_tokens, array_to_string(k, '|') AS tokens FROM (SELECT id, {STATUTORY} AS k FROM d)",
    "uuid5_ids": f"""SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS uuid
        FROM (SELECT doc_id, sha1(unhex('{DNS}') || encode(source || '_' || doc_id::VARCHAR)) AS h FROM documents)""",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "hybrid_retrieval": f"{_RANKED} SELECT id, source, dense_rank, bm25_rank, rrf_rank, rerank_rank, round(1 / (1 + exp(-raw)), 6) AS score, position FROM ({_DIVERSE.format(rank='rerank_rank', of='reranked')}) WHERE position <= 5",
}
