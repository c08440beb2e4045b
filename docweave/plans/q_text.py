"""Text queries on documents and conversations, dealt authored cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import language as lg
from .tables import DOCUMENTS_SQL, SOURCES_SQL, USER_SQL, documents_as, literal, spread, spread_sql, sql_values, table, turns_as, values

PUNCT = r"[^\p{L}\p{N}_\s]"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


CLEAN = [
    (1, "Page 1 of 9\r\nThe  first\tline \x01 here\r\n\r\n\r\n\r\n  12  \nPAGE 3\nEnd\r"),
    (2, "   \n\n"),
    (3, "no change"),
    (4, "a\n1 / 2\npage 4/7\n  x"),
]


def clean_text(spark, sf_dir):
    both = documents(spark, sf_dir).select("doc_id", "text").unionByName(values(spark, [(-i, t) for i, t in CLEAN], "doc_id bigint, text string"))
    c = tx.clean_text(F.col("text"))
    return both.select("doc_id", F.length(c).cast("bigint").alias("n_chars"), F.md5(c).alias("digest"))


def clean_sql(t: str) -> str:
    x = rf"regexp_replace({t}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?im)^\s*(?:page\s+\d+(?:\s*(?:of|/)\s*\d+)?|\d+)\s*$', '', 'g')"
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"array_to_string(list_transform(string_split({x}, chr(10)), lambda y: regexp_replace(regexp_replace(y, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10))"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


FOOT = [
    (1, "12[PART XVII] of [ 3 ] and [14]\n 2. Subs. by G.S.R. 5\n3. Ins. by x\n4. Kept line\n9[start"),
    (2, "1. Omitted by y"),
    (3, "plain [text] 5[ and 6 [7]"),
]


def clean_footnotes(spark, sf_dir):
    return spread(documents_as(spark, sf_dir), FOOT, "id int, text string", "id", ("text",), "\n").select("id", tx.clean_footnotes(F.col("text")).alias("text"))


def _foot_sql(t: str) -> str:
    x = rf"regexp_replace({t}, '\b\d+\[', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)^\s*\d+\[', '', 'g')"
    x = rf"regexp_replace({x}, '\[\s*\d+\s*\]', '', 'g')"
    return rf"regexp_replace({x}, '(?m)^\s*\d+\.\s+(?:Subs\.|Ins\.|Omitted|Added)\s+by\s+.*$', '', 'g')"


_FILL = "word " * 70
TOC = [
    (1, "ARRANGEMENT OF SECTIONS\n" + _FILL + "\nCHAPTER I\nbody"),
    (2, "SECTIONS " + _FILL + "\n1. Short title and extent"),
    (3, "short SECTIONS\nPRELIMINARY\nx"),
    (4, _FILL + "\nPRELIMINARY\nno list before"),
    (5, "no marker at all"),
]


def toc_filter(spark, sf_dir):
    return spread(documents_as(spark, sf_dir), TOC, "id int, text string", "id", ("text",), "\n").select("id", tx.drop_contents(F.col("text")).alias("text"))


BODY_RE2 = r"(?im)(?:^|\n\s*)(?:CHAPTER\s+I\b|PRELIMINARY\b|(?:Section\s+1|1)\.\s+Short\s+title)"

CITED = [
    (1, "What does sec 3(p) say about 2(1)(ja)?"),
    (2, "Explain rule 158-B and art. 27"),
    (3, "33-EEC of the act"),
    (4, "Section 3 of the Patents Act 1970 and 2023 amendment"),
    (5, "  nothing to do  "),
]


#: Between a citation and a turn's words, as those may begin with letters that an SQL engine takes for a word's end.
BEFORE = " — "


def normalize_citations(spark, sf_dir):
    x = spread(turns_as(spark, sf_dir), CITED, "id int, query string", "id", ("query",), BEFORE)
    return x.select("id", tx.normalize_citations(F.col("query")).alias("compat"), tx.normalize_citations(F.col("query"), strict=True).alias("strict"))


def chain_sql(t: str, steps: list[tuple[str, str]]) -> str:
    for p, r in steps:
        to = r
        for i in range(1, 10):
            to = to.replace(f"${i}", f"\\{i}")
        t = f"regexp_replace({t}, {literal(p)}, {literal(to)}, 'g')"
    return t


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

SPOKEN = [(1, "नमस्ते world"), (2, "ਪੰਜਾਬੀ then हिंदी"), (3, "தமிழ்"), (4, "മലയാളം"), (5, "plain English"), (6, ""), (7, "été 日本"), (8, None)]


def detect_language(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    both = d.unionByName(values(spark, [(-i, t) for i, t in SPOKEN], "doc_id bigint, text string"))
    return both.select("doc_id", tx.detect_language(F.col("text")).alias("language"), F.round(tx.ascii_letter_share(F.col("text")), 6).alias("ascii_share"))


def language_profiles(spark, sf_dir):
    """Each document's language by the nearest profile, fitted on a sample of each label, and whether it is that of its label."""
    d = documents(spark, sf_dir)
    found = d.select("doc_id", "lang", lg.detect(F.col("text"), lg.fit(d)).alias("code"))
    return found.select("doc_id", "code", F.col("code").eqNullSafe(F.col("lang")).alias("right"))


ASKED = [(1, " Hindi "), (2, "eng"), (3, "ta"), (4, "klingon"), (5, "PUN")]


def lang_alias(spark, sf_dir):
    x = spread(turns_as(spark, sf_dir), ASKED, "id int, target string", "id").withColumn("norm", F.lower(F.trim("target")))
    aliases = values(spark, fixed.LANGUAGE_ALIASES, "alias string, found string")
    known = values(spark, fixed.LANGUAGES, "code string, name string, native string, script string")
    y = x.join(aliases, x["norm"] == aliases["alias"], "left").withColumn("code", F.coalesce("found", "norm")).drop("alias", "found")
    y = y.join(known, "code", "left")
    return y.select("id", "code", F.coalesce("name", F.initcap("norm")).alias("name"), F.coalesce("native", F.initcap("norm")).alias("native"), F.coalesce("script", F.lit("standard")).alias("script"))


def cache_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", tx.cache_key(F.col("text"), F.lit("National"), F.lit("{}"), F.lit("en")).alias("key"))


def key_sql(t: str) -> str:
    x = rf"trim(regexp_replace(regexp_replace(lower({t}), '{PUNCT}', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"sha256({chain_sql(x, fixed.KEY_SYNONYMS)} || '|national|' || '{{}}' || '|en')"


def cache_hits(spark, sf_dir):
    """A request hits if its key was asked before, whatever the capacity of a cache."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("conv_id", "turn")
    return cache_key(spark, sf_dir).select("conv_id", "turn", F.lag("turn").over(w).isNotNull().alias("hit"))


def canonical_overlap(spark, sf_dir):
    """Canonical names of the sources that English and German documents share."""
    d = documents(spark, sf_dir).select("lang", tx.canonical_source(F.col("source")).alias("name")).where("name <> ''")
    return d.where("lang = 'en'").select("name").intersect(d.where("lang = 'de'").select("name"))


NAMES = [
    ("Patents Act 1970", "Patents Act, 1970"),
    ("WIPO GRATK Treaty (2024)", "WIPO GRATK Treaty 2024"),
    ("Nagoya Protocol", "nagoya   protocol"),
    ("Patents Act, 1970", "WIPO GRATK Treaty"),
]


def canonical_names(spark, sf_dir):
    x = spread(documents_as(spark, sf_dir, "source"), [(0, *n) for n in NAMES], "id int, a string, b string", "id", ("a", "b"))
    return x.select("id", "a", "b", (tx.canonical_source(F.col("a")) == tx.canonical_source(F.col("b"))).alias("equal"))


def canon_sql(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({t}), '{PUNCT}', '', 'g'), '\s+', ' ', 'g'))"


def word_batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    x = c.select("conv_id", "turn", F.posexplode(tx.word_batches(F.col("text"))).alias("seq", "delta"))
    return x.withColumn("seq", F.col("seq").cast("bigint"))


SPEECH = [
    (1, "**Section 3(p)** of the *Act* needs NBA &amp; SBBs approval.\n\n- see [Form 2-A](http://x)\n# Title\nRule 158-B (3)"),
    (2, "`code` TKDL_and D&C __bold__ &mdash; Section 2 (1)(ja)"),
    (3, "plain"),
]


def speech_clean(spark, sf_dir):
    return spread(documents_as(spark, sf_dir), SPEECH, "id int, text string", "id", ("text",), "\n").select("id", tx.speech_clean(F.col("text")).alias("text"))


def truncate(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tx.truncated(t, 260, 257).alias("excerpt"), tx.truncated(t, 180, 180).alias("snippet"), tx.truncated(t, 280, 280).alias("summary"), tx.truncated(t, 300, 297).alias("lead"))


def parse_llm_json(spark, sf_dir):
    """Assistant turns as a model might have put them: plain JSON, fenced, among other words, as text, and as a list."""
    t = turns_as(spark, sf_dir, "assistant")
    cites = F.array(F.struct(F.lit("A").alias("source"), F.col("row").cast("string").alias("section")))
    full = F.to_json(F.struct(F.col("text").alias("answer"), cites.alias("citations"), F.lit("high").alias("confidence"), F.lit(False).alias("abstained")))
    short = F.to_json(F.struct(F.col("text").alias("answer"), F.lit(True).alias("abstained")))
    kind = F.col("row") % 5
    raw = F.when(kind == 0, full).when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure: "), short, F.lit(" bye"))).when(kind == 3, F.col("text")).otherwise(F.concat(F.lit('["'), "text", F.lit('"]')))
    p = F.col("p")
    x = t.select(F.col("row").alias("id"), tx.parse_answer(raw).alias("p"))
    return x.select("id", p["answer"].alias("answer"), p["confidence"].alias("confidence"), p["abstained"].alias("abstained"), F.coalesce(F.size(p["citations"]), F.lit(-1)).alias("n_citations"))


def ordered_distinct(spark, sf_dir):
    """Each document's distinct words in the order of their first use."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_distinct(tx.words(F.col("text"))), " ").alias("words"))


REQUESTS = [
    (1, "What is it?", "national", "up"),
    (2, "", "national", "up"),
    (3, " \n\t ", "national", None),
    (4, None, "international", "down"),
    (5, "ok", "moon", None),
    (6, "ok", "International", " UP "),
    (7, "ok", None, "meh"),
]


def validate_requests(spark, sf_dir):
    x = spread(turns_as(spark, sf_dir), REQUESTS, "id int, query string, jurisdiction string, rating string", "id")
    x = x.union(turns_as(spark, sf_dir, "assistant").select("row", "text", F.lit("national"), F.lit("up")))
    bad_query = F.coalesce(tx.stripped(F.col("query")) == "", F.lit(True))
    bad_place = ~F.coalesce("jurisdiction", F.lit("national")).isin("national", "international")
    bad_rating = F.coalesce(~F.lower(F.trim("rating")).isin("up", "down"), F.lit(False))
    reason = F.when(bad_query, "query").when(bad_place, "jurisdiction").when(bad_rating, "rating")
    return x.select("id", reason.isNull().alias("valid"), reason.alias("reason"))


_NAMES = """clean_text clean_footnotes toc_filter normalize_citations detect_language language_profiles lang_alias cache_key cache_hits canonical_overlap canonical_names word_batches
speech_clean truncate parse_llm_json ordered_distinct validate_requests""".split()
QUERIES = {n: globals()[n] for n in _NAMES}


def _docs(extra: list[tuple]) -> str:
    return "(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM " + sql_values([(-i, t) for i, t in extra], "f", "doc_id, text") + ")"


def _cut(limit: int, keep: int) -> str:
    return f"CASE WHEN length(text) > {limit} THEN left(text, {keep}) || '...' ELSE text END"


_FIRST = "regexp_extract(text, '[ऀ-ॿ਀-੿஀-௿ഀ-ൿ]')"
ORACLE = {
    "clean_text": f"SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, {clean_sql('text')} AS c FROM {_docs(CLEAN)})",
    "clean_footnotes": f"SELECT id, {_foot_sql('text')} AS text FROM {spread_sql(DOCUMENTS_SQL, FOOT, 'f', 'id, text', 'id', ('text',), chr(10))}",
    "toc_filter": f"""SELECT id, CASE WHEN found <> '' AND at_pos > 301 AND (contains(head, 'SECTIONS') OR contains(head, 'ARRANGEMENT OF CLAUSES')) THEN substr(text, at_pos) ELSE text END AS text
        FROM (SELECT *, upper(left(text, at_pos - 1)) AS head FROM (SELECT *, strpos(text, found) AS at_pos FROM (SELECT *, regexp_extract(text, '{BODY_RE2}') AS found FROM {spread_sql(DOCUMENTS_SQL, TOC, 'f', 'id, text', 'id', ('text',), chr(10))})))""",
    "normalize_citations": f"SELECT id, {STRIP.format(chain_sql('query', tx.NORMALISE))} AS compat, {STRIP.format(chain_sql('query', tx.STRICT))} AS strict FROM {spread_sql(USER_SQL, CITED, 'f', 'id, query', 'id', ('query',), BEFORE)}",
    "detect_language": f"""SELECT doc_id, CASE WHEN c IS NULL OR c = '' THEN 'en' WHEN c BETWEEN 'ऀ' AND 'ॿ' THEN 'hi' WHEN c BETWEEN '਀' AND '੿' THEN 'pa' WHEN c BETWEEN '஀' AND '௿' THEN 'ta' ELSE 'ml' END AS language,
        round(CASE WHEN letters > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / letters END, 6) AS ascii_share
        FROM (SELECT *, {_FIRST} AS c, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters FROM {_docs(SPOKEN)})""",
    "lang_alias": f"""SELECT id, coalesce(found, norm) AS code, coalesce(name, upper(norm[1:1]) || norm[2:]) AS name, coalesce(native, upper(norm[1:1]) || norm[2:]) AS native, coalesce(script, 'standard') AS script
        FROM (SELECT *, lower(trim(target)) AS norm FROM {spread_sql(USER_SQL, ASKED, 'f', 'id, target', 'id')}) LEFT JOIN {sql_values(fixed.LANGUAGE_ALIASES, 'a', 'alias, found')} ON norm = alias LEFT JOIN {sql_values(fixed.LANGUAGES, 'k', 'code, name, native, script')} ON k.code = coalesce(found, norm)""",
    "cache_key": f"SELECT conv_id, turn, {key_sql('text')} AS key FROM conversations WHERE role = 'user'",
    "cache_hits": f"SELECT conv_id, turn, lag(turn) OVER (PARTITION BY key ORDER BY conv_id, turn) IS NOT NULL AS hit FROM (SELECT conv_id, turn, {key_sql('text')} AS key FROM conversations WHERE role = 'user')",
    "canonical_overlap": f"SELECT * FROM (SELECT {canon_sql('source')} AS name FROM documents WHERE lang = 'en' INTERSECT SELECT {canon_sql('source')} FROM documents WHERE lang = 'de') WHERE name <> ''",
    "canonical_names": f"SELECT id, a, b, {canon_sql('a')} = {canon_sql('b')} AS equal FROM {spread_sql(SOURCES_SQL, [(0, *n) for n in NAMES], 'f', 'id, a, b', 'id', ('a', 'b'))}",
    "word_batches": "SELECT conv_id, turn, i // 3 AS seq, array_to_string(w[i + 1 : i + 3], ' ') AS delta FROM (SELECT conv_id, turn, w, unnest(range(0, len(w), 3)) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'))",
    "speech_clean": f"SELECT id, trim({chain_sql('text', fixed.SPEECH_STEPS)}) AS text FROM {spread_sql(DOCUMENTS_SQL, SPEECH, 'f', 'id, text', 'id', ('text',), chr(10))}",
    "truncate": f"SELECT doc_id, {_cut(260, 257)} AS excerpt, {_cut(180, 180)} AS snippet, {_cut(280, 280)} AS summary, {_cut(300, 297)} AS lead FROM documents",
    "ordered_distinct": "WITH d AS (SELECT doc_id, {} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x), j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id) SELECT d.doc_id, CASE WHEN w IS NULL THEN NULL ELSE coalesce(words, '') END AS words FROM d LEFT JOIN j USING (doc_id)".replace("{}", "WORDS"),
    "validate_requests": rf"""SELECT id, reason IS NULL AS valid, reason FROM (SELECT id, CASE WHEN query IS NULL OR regexp_replace(query, '\s', '', 'g') = '' THEN 'query' WHEN coalesce(jurisdiction, 'national') NOT IN ('national', 'international') THEN 'jurisdiction'
        WHEN rating IS NOT NULL AND lower(trim(rating)) NOT IN ('up', 'down') THEN 'rating' END AS reason FROM (SELECT * FROM {spread_sql(USER_SQL, REQUESTS, 'f', 'id, query, jurisdiction, rating', 'id')} UNION ALL SELECT conv_id * 1000 + turn, text, 'national', 'up' FROM conversations WHERE role = 'assistant'))""",
    "parse_llm_json": """SELECT id, CASE WHEN kind = 4 THEN '["' || text || '"]' ELSE text END AS answer, CASE WHEN kind < 2 THEN 'high' WHEN kind > 2 THEN 'medium' END AS confidence, CASE WHEN kind = 2 THEN true ELSE false END AS abstained,
        CASE WHEN kind < 2 THEN 1 WHEN kind = 2 THEN -1 ELSE 0 END AS n_citations FROM (SELECT conv_id * 1000 + turn AS id, (conv_id * 1000 + turn) % 5 AS kind, text FROM conversations WHERE role = 'assistant')""",
}
from .q_rank import words_sql  # noqa: E402

ORACLE["ordered_distinct"] = ORACLE["ordered_distinct"].replace("WORDS", words_sql("text"))
