"""Rules and decision tables on the turns and documents of the tables, dealt authored cases and all combinations of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import rules as r
from .q_text import STRIP, chain_sql
from .tables import DOCUMENTS_SQL, SOURCES_SQL, USER_SQL, documents_as, literal, spread, spread_sql, sql_values, table, turns_as, values

ASKED = [
    (1, "I want to export a herbal supplement made from a plant sourced in Kerala — what approval do I need?", None),
    (2, "What are the ABS obligations for commercializing ashwagandha from Madhya Pradesh?", None),
    (3, "State Biodiversity Board intimation rules under the BD Act", None),
    (4, "What is Section 3(p) of the Patents Act?", None),
    (5, "Can a software algorithm be patented in India?", None),
    (6, "What does Section 3(p) of the Patents Act prohibit?", None),
    (7, "I want to sell my grandmother's Ayurvedic oil recipe, what IP protection do I need?", "classical_medicine"),
    (8, "My grandmother gave me a family recipe for a herbal joint pain oil made from classical Ayurvedic texts — can I patent it?", None),
    (9, "We want to formulate a new oil using sesame and ginger for arthritis.", "classical_medicine"),
    (10, "What are the requirements for trademark registration in Class 5?", None),
    (11, "How do patent examiners use TKDL to check prior art for traditional formulations?", None),
    (12, "Is turmeric patentable under Section 3(p)?", None),
    (13, "A multinational wants neem seeds collected in Goa for research only", None),
    (14, "An Indian company doing lab trial on unani cough syrup from outside a goal", None),
    (15, "Siddha churna powder for diabetes and sugar by an ayush practitioner", "cosmetic"),
    (16, "", None),
    (17, "inventive step and prior art for enhanced efficacy of a trademark registration", None),
    (18, "Nagoya protocol form 2 & access & benefit-sharing", None),
]


def requests(spark, sf_dir):
    """Each user turn behind an authored question."""
    return spread(turns_as(spark, sf_dir), ASKED, "query_id int, query string, classification string", "query_id", ("query",))


REQUESTS = spread_sql(USER_SQL, ASKED, "q", "query_id, query, classification", "query_id", ("query",))


def choices(names: list[str], id: str = "row", div: str = "div") -> dict[str, str]:
    """Expressions by which the rows of a table run through all answers (yes, no, unknown) to the questions of these names."""
    return {n: f"CASE ({id} {div} {3**i}) % 3 WHEN 0 THEN true WHEN 1 THEN false END" for i, n in enumerate(names)}


def answered(spark, sf_dir, names):
    return documents_as(spark, sf_dir).select(F.col("row").alias("doc_id"), *(F.expr(e).alias(n) for n, e in choices(names).items()))


def answered_sql(names: list[str]) -> str:
    return f"(SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in choices(names, 'doc_id', '//').items())} FROM documents)"


def any_sql(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, {literal('|'.join(f'(?:{p})' for p in patterns))})"


def word_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {literal(w)})" for w in words) + ")"


Q = "lower(query)"
INTENT = f"(NOT {any_sql(Q, fixed.STATUTE_VETO_PATTERNS)} AND NOT {any_sql(Q, fixed.PATENT_VETO_PATTERNS)} AND {word_sql(Q, fixed.FORMULATION_PHRASES)})"
CLASSICAL = any_sql(Q, fixed.CLASSICAL_PATTERNS)
TRIGGER = f"({any_sql(Q, r.phrase_patterns(fixed.ABS_PHRASES))} OR ({any_sql(Q, fixed.BIO_PATTERNS)} AND ({any_sql(Q, fixed.SOURCE_PATTERNS)} OR {any_sql(Q, fixed.COMMERCIAL_PATTERNS)} OR {word_sql(Q, [s for s, _ in fixed.STATE_BOARDS])})))"


def intent_rules(spark, sf_dir):
    q = F.col("query")
    return requests(spark, sf_dir).select("query_id", r.intent(q).alias("specific"), r.question_gate(q, F.col("classification").isNotNull(), F.col("classification")).alias("gate"))


def abs_trigger(spark, sf_dir):
    return requests(spark, sf_dir).select("query_id", r.abs_trigger(F.col("query")).alias("triggered"))


def abs_extract(spark, sf_dir):
    said = r.abs_answers(F.col("query"))
    return requests(spark, sf_dir).select("query_id", r.state_in(F.col("query")).alias("state"), *(c.alias(n) for n, c in said.items()))


STATE = "CASE " + " ".join(f"WHEN regexp_matches({Q}, '\\b{s}\\b') THEN {literal(' '.join(w.capitalize() for w in s.split()))}" for s, _ in fixed.STATE_BOARDS) + " END"
SAID = {n: f"CASE WHEN {word_sql(Q, yes)}" + (f" OR {STATE} IS NOT NULL" if n == "is_sourced_from_india" else "") + f" THEN true WHEN {word_sql(Q, no)} THEN false END" for n, yes, no in fixed.ABS_ANSWER_WORDS}


def tkdl_trigger(spark, sf_dir):
    return requests(spark, sf_dir).select("query_id", r.classical(F.col("query")).alias("classical"), r.tkdl_trigger(F.col("query"), F.col("classification")).alias("triggered"))


def tkdl_hints(spark, sf_dir):
    h = r.tkdl_hints(F.col("query"))
    joined = {"classes", "source_texts", "keywords"}
    return requests(spark, sf_dir).select("query_id", *((F.array_join(c, "; ") if n in joined else c).alias(n) for n, c in h.items()))


def _hints_sql() -> str:
    prep = "CASE " + " ".join(f"WHEN {word_sql(Q, w)} THEN {literal(t)}" for t, w in fixed.PREPARATIONS) + f" ELSE {literal(fixed.PREPARATION_DEFAULT)} END"
    area = "CASE " + " ".join(f"WHEN {word_sql(Q, w)} THEN {literal(t)}" for t, w, _ in fixed.AREAS) + f" ELSE {literal(fixed.AREA_DEFAULT)} END"
    classes = "CASE " + " ".join(f"WHEN {word_sql(Q, w)} THEN {literal('; '.join([fixed.BASE_CLASS, *c]))}" for _, w, c in fixed.AREAS) + f" ELSE {literal(fixed.BASE_CLASS)} END"
    oil = [*fixed.CLASSICAL_TEXTS[:2], fixed.OIL_TEXT, *fixed.CLASSICAL_TEXTS[2:]]
    texts = f"CASE WHEN contains({Q}, 'unani') THEN {literal('; '.join(fixed.UNANI_TEXTS))} WHEN contains({Q}, 'siddha') THEN {literal('; '.join(fixed.SIDDHA_TEXTS))} WHEN {word_sql(Q, ['kerala', 'oil', 'taila'])} THEN {literal('; '.join(oil))} ELSE {literal('; '.join(fixed.CLASSICAL_TEXTS))} END"
    plants = f"list_transform(list_filter({literal(fixed.BOTANICALS)}, lambda w: contains({Q}, w)), lambda w: upper(w[1:1]) || w[2:])"
    return f"SELECT query_id, preparation, area, classes, source_texts, CASE WHEN len(plants) > 0 THEN array_to_string(plants, '; ') ELSE 'Classical Ayurvedic preparation; ' || split_part(preparation, ' (', 1) END AS keywords FROM (SELECT query_id, {prep} AS preparation, {area} AS area, {classes} AS classes, {texts} AS source_texts, {plants} AS plants FROM {REQUESTS})"


def expand_rules(spark, sf_dir):
    rules = values(spark, [(i, p, e) for i, (p, e) in enumerate(fixed.EXPANSIONS)], "ord int, pattern string, expansion string")
    q = requests(spark, sf_dir).select("query_id", tx.normalize_citations(F.col("query")).alias("query"))
    return r.expand(q, rules)


RULES = sql_values([(i, p, e) for i, (p, e) in enumerate(fixed.EXPANSIONS)], "rules", "ord, pattern, expansion")

def formulation_tree(spark, sf_dir):
    x = answered(spark, sf_dir, fixed.FORMULATION_QUESTIONS)
    cls = r.formulation_class([F.col(n) for n in fixed.FORMULATION_QUESTIONS])
    cites = values(spark, fixed.CLASS_CITATIONS, "class string, citation string")
    return x.withColumn("class", cls).join(cites, "class").select("doc_id", *fixed.FORMULATION_QUESTIONS, "class", "citation")


def formulation_next(spark, sf_dir):
    x = answered(spark, sf_dir, fixed.FORMULATION_QUESTIONS)
    return x.select("doc_id", *fixed.FORMULATION_QUESTIONS, r.formulation_next([F.col(n) for n in fixed.FORMULATION_QUESTIONS]).alias("next_question"))


ANSWER_WORDS = [(1, "Yes"), (2, " y "), (3, "TRUE"), (4, "1"), (5, "no"), (6, "commercial"), (7, "Indian"), (8, "maybe"), (9, None), (10, "research")]


def answer_words(spark, sf_dir):
    x = spread(turns_as(spark, sf_dir), ANSWER_WORDS, "id int, answer string", "id")
    return x.select("id", r.yes(F.col("answer")).alias("plain"), r.abs_yes(F.col("answer")).alias("three_way"))


_ABS = [n for n, _, _ in fixed.ABS_ANSWER_WORDS]


def outcomes(spark):
    return values(spark, fixed.ABS_OUTCOMES, "outcome string, authority boolean, board boolean, provision string")


def abs_outcomes(spark, sf_dir):
    x = answered(spark, sf_dir, _ABS)
    cols = [F.col(n) for n in _ABS]
    x = x.withColumn("outcome", r.abs_outcome(*cols)).withColumn("next_question", r.abs_next_question(*cols))
    return x.join(outcomes(spark), "outcome").select("doc_id", *_ABS, "outcome", "next_question", "authority", "board", "provision")


def _given(query_id: str) -> dict[str, str]:
    return {"is_sourced_from_india": "NULL", "is_commercial_use": "NULL", "is_foreign_entity": f"CASE {query_id} % 18 WHEN 1 THEN false WHEN 4 THEN true END"}


def abs_flow(spark, sf_dir):
    given = {n: F.expr(f"CAST({e} AS BOOLEAN)") for n, e in _given("query_id").items()}
    x = requests(spark, sf_dir).select("query_id", "query", *(c.alias(n) for n, c in given.items()))
    return r.abs_flow(x, outcomes(spark)).select("query_id", "triggered", "status", *_ABS, "next_question", "outcome", "state", "authority", "board")


_OUTCOME = "CASE WHEN NOT {0} THEN 'not_india' WHEN {1} AND NOT {2} THEN 'domestic_commercial' WHEN {1} AND {2} THEN 'foreign_commercial' WHEN NOT {1} AND NOT {2} THEN 'domestic_research' WHEN NOT {1} AND {2} THEN 'foreign_research' ELSE 'undetermined' END".format(*_ABS)
_NEXT = "CASE WHEN {0} IS NULL THEN '{3}' WHEN NOT {0} THEN NULL WHEN {1} IS NULL THEN '{4}' WHEN {2} IS NULL THEN '{5}' END".format(*_ABS, *fixed.ABS_QUESTIONS)
OUTCOMES = sql_values(fixed.ABS_OUTCOMES, "o", "outcome, authority, board, provision")

FOLLOW = [
    (1, "Translate the above answer to Hindi", None, "Answer one.", "assistant"),
    (2, "हिंदी में", None, "Answer two.", "assistant"),
    (3, "in tamil please", None, "Answer three.", "assistant"),
    (4, "unrelated question", "convert this to malayalam", "Answer four.", "assistant"),
    (5, "punjabi version", None, "Answer five.", "assistant"),
    (6, "what about trademarks?", None, "Answer six.", "assistant"),
    (7, "english please", None, None, None),
    (8, "angrezi mein hindi", None, "Answer eight.", "assistant"),
]


def followup_translate(spark, sf_dir):
    """Requests to put the last answer into another language; without a last answer there is nothing to translate."""
    x = spread(turns_as(spark, sf_dir), FOLLOW, "id int, query string, english string, last string, role string", "id", ("last",))
    target = F.when(F.col("last").isNotNull(), r.translation_target(F.col("query"), F.col("english")))
    return x.withColumn("target", target).select("id", "target", F.when(F.col("target").isNotNull(), F.trim("last")).alias("text"))


def _target_sql() -> str:
    a, b = "trim(lower(query))", "trim(lower(coalesce(english, query)))"
    return "CASE " + " ".join(f"WHEN {any_sql(a, p)} OR {any_sql(b, p)} THEN '{c}'" for c, p in r.TRANSLATIONS) + " END"


SOURCES = [
    (1, "PCT article 8"), (2, "The Patents Act"), (3, "Magic Remedies Act"), (4, "BD Rules 2024"), (5, "Biological Diversity Rules, 2025"), (6, "Trade Mark"), (7, "nothing known"), (8, "GI Act design"),
    (9, "biodiversity"), (10, "Schedule T"), (11, "FSSAI aahara"), (12, None), (13, "WTO wipo gratk"),
]


def first_match_rules(spark, sf_dir):
    x = spread(documents_as(spark, sf_dir, "source"), SOURCES, "id int, source string", "id", ("source",))
    files = values(spark, [(i, k, f) for i, (k, f) in enumerate(fixed.FILE_KEYWORDS)], "ord int, keyword string, file string")
    urls = values(spark, [(i, k, u) for i, (k, u) in enumerate(fixed.URL_KEYWORDS)], "ord int, keyword string, url string")
    a = r.first_match(x, files, "source", "id").select("id", "source", "file")
    b = r.first_match(x, urls, "source", "id").select("id", "url")
    return a.join(b, "id").select("id", "file", "url", r.client_file(F.coalesce("source", F.lit(""))).alias("client_file"))


def _first_sql(table_: list[tuple], text: str = "source") -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), {literal(k)}) THEN {literal(v)}" for k, v in table_) + " END"


_CLIENT = "CASE " + " ".join("WHEN " + " AND ".join([word_sql("lower(coalesce(source, ''))", some), *(f"contains(lower(coalesce(source, '')), {literal(w)})" for w in every)]) + f" THEN {literal(f)}" for some, every, f in fixed.CLIENT_FILE_RULES) + f" ELSE {literal(fixed.DEFAULT_FILE)} END"

PAGES = [("a.pdf", "3(p)", 12, 1), ("a.pdf", "3", 11, 2), ("a.pdf", "form 1", 22, 3), ("a.pdf", "27", 40, 4), ("b.pdf", "6", 9, 1), ("b.pdf", "preamble", 2, 2)]
CITES = [(1, "a.pdf", "Section 3(p)"), (2, "a.pdf", "3(p)"), (3, "a.pdf", "Section 3(d)"), (4, "a.pdf", "See Form 1"), (5, "a.pdf", "Article 99"), (6, "b.pdf", "The Preamble"), (7, "c.pdf", "3"), (8, "b.pdf", "art 6(2)"), (9, "a.pdf", "")]


def page_resolve(spark, sf_dir):
    reg = values(spark, PAGES, "r_file string, r_key string, r_page int, r_ord int")
    return r.resolve_page(spread(documents_as(spark, sf_dir), CITES, "id int, file string, section string", "id"), reg).select("id", "page")


TO_RESOLVE = [(1, "Patents Act", "Section 3(p)"), (2, "pat", "27"), (3, "Unknown Act", None), (4, "Nagoya Protocol", "Article 6"), (5, "des", "Form 1")]
REGISTRY = [("Patents Act, 1970.pdf", "3(p)", 12, 1), ("Patents Act, 1970.pdf", "form 1", 22, 2), ("Nagoya Protocol.pdf", "6", 9, 1)]


def citation_resolve(spark, sf_dir):
    files = values(spark, [(i, k, f) for i, (k, f) in enumerate(fixed.FILE_KEYWORDS)], "ord int, keyword string, file string")
    urls = values(spark, [(i, k, u) for i, (k, u) in enumerate(fixed.URL_KEYWORDS)], "ord int, keyword string, url string")
    reg = values(spark, REGISTRY, "r_file string, r_key string, r_page int, r_ord int")
    c = spread(documents_as(spark, sf_dir), TO_RESOLVE, "id int, source string, section string", "id")
    return r.resolve_citations(c, alias_last_wins(spark, sf_dir), files, urls, reg)


def tkdl_pointer(spark, sf_dir):
    p = F.col("pointer")
    x = requests(spark, sf_dir).select("query_id", r.tkdl_pointer(F.col("query"), F.col("classification")).alias("pointer")).where(p.isNotNull())
    return x.select("query_id", p["preparation"].alias("preparation"), p["area"].alias("area"), F.array_join(p["classes"], "; ").alias("classes"))


MANIFEST = [
    (1, "Patents Act, 1970", "PAT", "IND-1", "Patents.pdf", "http://a"),
    (2, "Designs Act", "DES", "IND-2", " ", "http://b"),
    (3, "patents act, 1970", "pat ", "IND-3", "x.pdf", "http://c"),
    (4, None, "DES", "ind-1", "y.pdf", "http://d"),
]


def alias_last_wins(spark, sf_dir):
    x = spread(documents_as(spark, sf_dir), MANIFEST, "ord int, title string, prefix string, id string, filename string, url string", "ord")
    x = x.withColumn("id", F.concat_ws("-", "id", "ord")).withColumn("url", F.concat("url", F.lit("?d="), "ord"))
    return r.last_wins(x, ["title", "prefix", "id", "filename"], "url", "ord")


SCORES = [(1, 1.7), (2, 0.95), (3, 0.6), (4, 0.41), (5, 0.4), (6, -2.0), (7, 1.0), (8, 0.8)]


def piecewise_clamp(spark, sf_dir):
    scored = spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.col("event_type").alias("text")), SCORES, "id int, top double", "id")
    return scored.select("id", F.round(r.display_score(F.col("top")), 6).alias("display_score"), r.confidence(F.col("top")).alias("abstained"))


def followup_rewrite(spark, sf_dir):
    """Each user turn with the user turn before it, where it is a follow-up."""
    from pyspark.sql import Window

    u = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 3 == 0, F.lit("What about ")).otherwise(F.lit("")), F.col("text")).alias("query"))
    prior = F.lag("query").over(Window.partitionBy("conv_id").orderBy("turn"))
    return u.withColumn("prior", prior).select("conv_id", "turn", r.in_context(F.col("query"), F.col("prior"), F.when(F.col("conv_id") % 2 == 0, "national").otherwise("international")).alias("rewritten"))


_NAMES = """intent_rules abs_trigger abs_extract tkdl_trigger tkdl_hints expand_rules formulation_tree formulation_next answer_words abs_outcomes abs_flow followup_translate
first_match_rules page_resolve alias_last_wins citation_resolve tkdl_pointer piecewise_clamp followup_rewrite""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_F = fixed.FORMULATION_QUESTIONS
_CLASS = "CASE " + " ".join(f"WHEN {q} THEN '{c}'" for q, c in zip(_F, ["classical_medicine", "new_drug", "phytopharmaceutical", "nutraceutical", "cosmetic"], strict=True)) + " ELSE 'proprietary_medicine' END"
_FNEXT = "CASE " + " ".join(f"WHEN {q} IS NULL THEN '{q}' WHEN {q} THEN NULL" for q in _F) + " END"
_FOLLOWED = rf"""(({any_sql("trim(lower(query))", fixed.FOLLOWUP_PATTERNS)}) OR (len(w) <= 8 AND list_has_any(w, {literal(fixed.ANAPHORA)})))"""
_SAID = "concat_ws(' ', source, section)"
_ALIASES = f"""SELECT alias, arg_max(url || '?d=' || o, o * 10 + i) AS url FROM (SELECT ord AS o, url, i, trim(lower(CASE i WHEN 0 THEN title WHEN 1 THEN prefix WHEN 2 THEN id || '-' || ord ELSE filename END)) AS alias
    FROM {spread_sql(DOCUMENTS_SQL, MANIFEST, 'm', 'ord, title, prefix, id, filename, url', 'ord')}, (SELECT unnest(range(4)) AS i)) WHERE alias <> '' GROUP BY alias"""


def _pages_sql(citations: str, registry: list[tuple]) -> str:
    """CTEs that end in paged: citations(id, file, section, ...) with page."""
    return rf"""WITH c AS (SELECT *, trim(lower(section)) AS s, regexp_extract(trim(lower(section)), '(\d+[a-z]?(?:\([a-z0-9]+\))*|\b\d+[a-z]?\b)', 1) AS num FROM {citations}),
        j AS (SELECT *, CASE WHEN r_key = s THEN 1 WHEN r_key = num THEN 2 WHEN r_key = trim(regexp_replace(num, '\(.*?\)', '', 'g')) THEN 3 WHEN contains(s, r_key) THEN 4 ELSE 5 END AS k FROM c LEFT JOIN {sql_values(registry, 'r', 'r_file, r_key, r_page, r_ord')} ON file = r_file),
        paged AS (SELECT *, CASE WHEN r_file IS NULL OR section = '' THEN NULL WHEN k < 5 THEN r_page ELSE 1 END AS page FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, r_ord) AS n FROM j) WHERE n = 1)"""


ORACLE = {
    "intent_rules": f"SELECT query_id, {INTENT} AS specific, CASE WHEN classification IS NOT NULL THEN classification WHEN {INTENT} THEN 'ask' WHEN {CLASSICAL} THEN 'classical_medicine' ELSE 'general' END AS gate FROM {REQUESTS}",
    "abs_trigger": f"SELECT query_id, {TRIGGER} AS triggered FROM {REQUESTS}",
    "abs_extract": f"SELECT query_id, {STATE} AS state, {', '.join(f'{e} AS {n}' for n, e in SAID.items())} FROM {REQUESTS}",
    "tkdl_trigger": f"SELECT query_id, {CLASSICAL} AS classical, {any_sql(Q, fixed.PRIOR_ART_PATTERNS)} AND (coalesce(classification = 'classical_medicine', false) OR {CLASSICAL}) AS triggered FROM {REQUESTS}",
    "tkdl_hints": _hints_sql(),
    "expand_rules": f"""WITH q AS (SELECT query_id, {STRIP.format(chain_sql('query', tx.NORMALISE))} AS query FROM {REQUESTS})
        SELECT query_id, query, trim(query || coalesce(' ' || string_agg(expansion, ' ' ORDER BY ord), '')) AS expanded FROM q LEFT JOIN {RULES} ON regexp_matches(query, pattern) GROUP BY query_id, query""",
    "formulation_tree": f"SELECT * FROM (SELECT *, {_CLASS} AS class FROM {answered_sql(_F)}) t JOIN {sql_values(fixed.CLASS_CITATIONS, 'c', 'class, citation')} USING (class)",
    "formulation_next": f"SELECT *, {_FNEXT} AS next_question FROM {answered_sql(_F)}",
    "answer_words": f"SELECT id, coalesce(lower(trim(answer)) IN ('yes', 'y', 'true', '1'), false) AS plain, CASE WHEN list_contains({literal(fixed.ABS_YES_WORDS)}, lower(trim(answer))) THEN true WHEN list_contains({literal(fixed.ABS_NO_WORDS)}, lower(trim(answer))) THEN false END AS three_way FROM {spread_sql(USER_SQL, ANSWER_WORDS, 'a', 'id, answer', 'id')}",
    "abs_outcomes": f"SELECT doc_id, {', '.join(_ABS)}, outcome, next_question, authority, board, provision FROM (SELECT *, {_OUTCOME} AS outcome, {_NEXT} AS next_question FROM {answered_sql(_ABS)}) JOIN {OUTCOMES} USING (outcome)",
    "abs_flow": f"""WITH m AS (SELECT query_id, {STATE} AS state, {TRIGGER} OR {' OR '.join(f'({e}) IS NOT NULL' for e in _given('query_id').values())} AS triggered, {', '.join(f'coalesce({_given("query_id")[n]}, {SAID[n]}) AS {n}' for n in _ABS)} FROM {REQUESTS}),
        f AS (SELECT *, CASE WHEN triggered THEN {_NEXT} END AS next_question, CASE WHEN triggered THEN {_OUTCOME} END AS outcome FROM m)
        SELECT query_id, triggered, CASE WHEN NOT triggered THEN 'not_triggered' WHEN next_question IS NULL THEN 'completed' ELSE 'needs_input' END AS status, {', '.join(_ABS)}, next_question, outcome, state, authority, board FROM f LEFT JOIN {OUTCOMES} USING (outcome)""",
    "followup_translate": f"SELECT id, CASE WHEN last IS NOT NULL THEN {_target_sql()} END AS target, CASE WHEN last IS NOT NULL AND {_target_sql()} IS NOT NULL THEN trim(last) END AS text FROM {spread_sql(USER_SQL, FOLLOW, 'f', 'id, query, english, last, role', 'id', ('last',))}",
    "first_match_rules": f"SELECT id, {_first_sql(fixed.FILE_KEYWORDS)} AS file, {_first_sql(fixed.URL_KEYWORDS)} AS url, {_CLIENT} AS client_file FROM {spread_sql(SOURCES_SQL, SOURCES, 's', 'id, source', 'id', ('source',))}",
    "page_resolve": f"{_pages_sql(spread_sql(DOCUMENTS_SQL, CITES, 'c0', 'id, file, section', 'id'), PAGES)} SELECT id, page FROM paged",
    "alias_last_wins": _ALIASES,
    "citation_resolve": f"""{_pages_sql(f"(SELECT id, source, coalesce(section, '') AS section, coalesce({_first_sql(fixed.FILE_KEYWORDS, _SAID)}, {literal(fixed.DEFAULT_FILE)}) AS file, {_first_sql(fixed.URL_KEYWORDS, _SAID)} AS found FROM {spread_sql(DOCUMENTS_SQL, TO_RESOLVE, 'c1', 'id, source, section', 'id')})", REGISTRY)}
        SELECT id, file, page, '/pdf/' || url_encode(file) || CASE WHEN page IS NOT NULL THEN '#page=' || page ELSE '' END AS link, coalesce(url, found) AS official_url FROM paged LEFT JOIN ({_ALIASES}) ON alias = trim(lower(source))""",
    "tkdl_pointer": f"SELECT query_id, preparation, area, classes FROM ({_hints_sql()}) JOIN {REQUESTS} USING (query_id) WHERE {any_sql(Q, fixed.PRIOR_ART_PATTERNS)} AND (coalesce(classification = 'classical_medicine', false) OR {CLASSICAL})",
    "piecewise_clamp": f"SELECT id, round(least(99.9, greatest(92.0, round_even(CASE WHEN top > 1.0 THEN 99.4 WHEN top > 0.8 THEN 92.0 + top * 7.5 WHEN top > 0.4 THEN 88.0 + top * 10.0 ELSE 95.0 END, 1))), 6) AS display_score, top < 0.3 AS abstained FROM (SELECT id, top::DOUBLE AS top FROM {spread_sql("SELECT event_id AS row, event_type AS text FROM events", SCORES, 's', 'id, top', 'id')})",
    "followup_rewrite": f"""WITH u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'What about ' ELSE '' END || text AS query FROM conversations WHERE role = 'user'),
        p AS (SELECT *, lag(query) OVER (PARTITION BY conv_id ORDER BY turn) AS prior, regexp_split_to_array(trim(lower(query)), '\\s+') AS w FROM u)
        SELECT conv_id, turn, CASE WHEN prior IS NOT NULL AND {_FOLLOWED} THEN CASE WHEN conv_id % 2 <> 0 THEN query || ' (Prior subject: protection and patentability of ' || trim(regexp_replace(prior, '[?!.,]', '', 'g')) || ' under international treaties TRIPS CBD Nagoya Protocol WIPO GRATK)'
            ELSE query || ' (Prior subject from turn: ' || trim(regexp_replace(prior, '[?!.,]', '', 'g')) || ' patentability criteria comparison)' END ELSE query END AS rewritten FROM p""",
}
