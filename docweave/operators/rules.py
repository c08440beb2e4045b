"""Table-driven rules and decision tables as column expressions and broadcast joins.

Word lists and patterns come in as parameters or from `functions.fixed`. Contained words match inside longer ones
("goa" in "goal"); patterns are those of the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import stripped, truncated


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """One alternation, so that a text is scanned once by a compiled pattern."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def phrase_patterns(phrases: list[str]) -> list[str]:
    return [r"\b" + p.replace("&", r"\&").replace("-", r"\-") + r"\b" for p in phrases]


def first_match(rows: DataFrame, rules: DataFrame, text: str, key: str, keyword: str = "keyword", order: str = "ord") -> DataFrame:
    """For each row the first rule, in order, whose keyword is in the text; rows without one keep nulls.

    The rules are a small table by nature (its size decides whether it is broadcast); a row meets each rule once.
    """
    hits = rows.join(rules, F.lower(F.col(text)).contains(F.col(keyword)), "left")
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(order)))
    return hits.withColumn("_n", n).where("_n = 1").drop("_n")


def first_word_case(text: Column, rules: list[tuple], default: object) -> Column:
    """(value, words) rules as a chain: the first whose word is in the text."""
    out = F.lit(default)
    for value, words, *_ in reversed(rules):
        out = F.when(any_word(text, words), F.lit(value)).otherwise(out)
    return out


def expand(queries: DataFrame, rules: DataFrame, text: str = "query", key: str = "query_id") -> DataFrame:
    """queries with `expanded`: the text and, in rule order, what each matching rule appends. All queries stay."""
    hits = queries.join(rules, F.expr(f"{text} rlike pattern"), "left")
    found = F.transform(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "expansion")))), lambda x: x["expansion"])
    return hits.groupBy(key, text).agg(found.alias("_more")).select(key, text, F.trim(F.concat_ws(" ", F.col(text), F.array_join("_more", " "))).alias("expanded"))


def intent(query: Column) -> Column:
    """Whether a question is about a product of its own: vetoed by citations and patent questions."""
    q = F.lower(query)
    return ~any_pattern(q, fixed.STATUTE_VETO_PATTERNS) & ~any_pattern(q, fixed.PATENT_VETO_PATTERNS) & any_word(q, fixed.FORMULATION_PHRASES)


def abs_trigger(query: Column) -> Column:
    q = F.lower(query)
    more = any_pattern(q, fixed.SOURCE_PATTERNS) | any_pattern(q, fixed.COMMERCIAL_PATTERNS) | any_word(q, [s for s, _ in fixed.STATE_BOARDS])
    return any_pattern(q, phrase_patterns(fixed.ABS_PHRASES)) | (any_pattern(q, fixed.BIO_PATTERNS) & more)


def classical(query: Column) -> Column:
    return any_pattern(F.lower(query), fixed.CLASSICAL_PATTERNS)


def tkdl_trigger(query: Column, classification: Column) -> Column:
    """Patent or prior-art language, in a question that is classical by classification or by its words."""
    is_classical = F.coalesce(classification == "classical_medicine", F.lit(False)) | classical(query)
    return F.coalesce(any_pattern(F.lower(query), fixed.PRIOR_ART_PATTERNS) & is_classical, F.lit(False))


def state_in(query: Column) -> Column:
    """The first state of the table that is in the text as a whole word, in title case."""
    q, out = F.lower(query), F.lit(None).cast("string")
    for state, _ in reversed(fixed.STATE_BOARDS):
        out = F.when(q.rlike(rf"\b{state}\b"), F.lit(state)).otherwise(out)
    return F.initcap(out)


def abs_answers(query: Column) -> dict[str, Column]:
    """The three answers read off a question's text: true, false, or null for not said."""
    q = F.lower(query)
    out = {}
    for name, yes, no in fixed.ABS_ANSWER_WORDS:
        is_yes = any_word(q, yes)
        if name == "is_sourced_from_india":
            is_yes = is_yes | state_in(query).isNotNull()
        out[name] = F.when(is_yes, F.lit(True)).when(any_word(q, no), F.lit(False))
    return out


def yes(value: Column) -> Column:
    """Text to a boolean: anything but a word for yes is no."""
    return F.coalesce(F.lower(F.trim(value)).isin(*fixed.YES_WORDS), F.lit(False))


def abs_yes(value: Column) -> Column:
    """Text to a boolean with a third state: null for what is neither yes nor no."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*fixed.ABS_YES_WORDS), F.lit(True)).when(v.isin(*fixed.ABS_NO_WORDS), F.lit(False))


def abs_outcome(india: Column, commercial: Column, foreign: Column) -> Column:
    return (
        F.when(~india, F.lit("not_india"))
        .when(commercial & ~foreign, F.lit("domestic_commercial"))
        .when(commercial & foreign, F.lit("foreign_commercial"))
        .when(~commercial & ~foreign, F.lit("domestic_research"))
        .when(~commercial & foreign, F.lit("foreign_research"))
        .otherwise(F.lit("undetermined"))
    )


def abs_next_question(india: Column, commercial: Column, foreign: Column) -> Column:
    a, b, c = fixed.ABS_QUESTIONS
    return F.when(india.isNull(), F.lit(a)).when(~india, None).when(commercial.isNull(), F.lit(b)).when(foreign.isNull(), F.lit(c))


def abs_flow(requests: DataFrame, outcomes: DataFrame, query: str = "query") -> DataFrame:
    """requests with trigger, merged answers, status, next question and outcome; given answers override those read off
    the text unless null. Not triggered and nothing answered: the flow stops."""
    names = [n for n, _, _ in fixed.ABS_ANSWER_WORDS]
    said = abs_answers(F.col(query))
    merged = {n: F.coalesce(F.col(n), said[n]) for n in names}
    started = abs_trigger(F.col(query)) | reduce(lambda a, b: a | b, (F.col(n).isNotNull() for n in names))
    x = requests.select(*(c for c in requests.columns if c not in names), started.alias("triggered"), *(merged[n].alias(n) for n in names))
    cols = [F.col(n) for n in names]
    following = abs_next_question(*cols)
    x = x.withColumn("next_question", F.when(F.col("triggered"), following))
    x = x.withColumn("status", F.when(~F.col("triggered"), "not_triggered").when(F.col("next_question").isNull(), "completed").otherwise("needs_input"))
    x = x.withColumn("outcome", F.when(F.col("triggered"), abs_outcome(*cols))).withColumn("state", state_in(F.col(query)))
    return x.join(outcomes, "outcome", "left")


def formulation_class(answers: list[Column]) -> Column:
    """The class of the first question answered with yes; answers in the questions' order."""
    names = ["classical_medicine", "new_drug", "phytopharmaceutical", "nutraceutical", "cosmetic"]
    out = F.lit("proprietary_medicine")
    for a, n in reversed(list(zip(answers, names, strict=True))):
        out = F.when(F.coalesce(a, F.lit(False)), F.lit(n)).otherwise(out)
    return out


def formulation_next(answers: list[Column]) -> Column:
    """The first question on the path without an answer; null once a yes or the last no settles the class."""
    out = F.lit(None).cast("string")
    for a, q in reversed(list(zip(answers, fixed.FORMULATION_QUESTIONS, strict=True))):
        out = F.when(a.isNull(), F.lit(q)).when(a, F.lit(None).cast("string")).otherwise(out)
    return out


def question_gate(query: Column, answered: Column, formulation: Column) -> Column:
    """What classification a request gets: from answers, a question to ask, or from the words of the query."""
    return F.when(answered, formulation).when(intent(query), F.lit("ask")).when(classical(query), F.lit("classical_medicine")).otherwise(F.lit("general"))


def tkdl_hints(query: Column) -> dict[str, Column]:
    q = F.lower(F.coalesce(query, F.lit("")))
    preparation = first_word_case(q, fixed.PREPARATIONS, fixed.PREPARATION_DEFAULT)
    area = first_word_case(q, fixed.AREAS, fixed.AREA_DEFAULT)
    classes = F.array(F.lit(fixed.BASE_CLASS))
    for name, _, codes in fixed.AREAS:
        classes = F.when(area == name, F.array(*map(F.lit, [fixed.BASE_CLASS, *codes]))).otherwise(classes)
    lits = lambda xs: F.array(*map(F.lit, xs))
    texts = F.when(any_word(q, ["kerala", "oil", "taila"]), lits([*fixed.CLASSICAL_TEXTS[:2], fixed.OIL_TEXT, *fixed.CLASSICAL_TEXTS[2:]])).otherwise(lits(fixed.CLASSICAL_TEXTS))
    texts = F.when(q.contains("unani"), lits(fixed.UNANI_TEXTS)).when(q.contains("siddha"), lits(fixed.SIDDHA_TEXTS)).otherwise(texts)
    plants = F.transform(F.filter(lits(fixed.BOTANICALS), lambda w: q.contains(w)), F.initcap)
    fallback = F.array(F.lit("Classical Ayurvedic preparation"), F.substring_index(preparation, " (", 1))
    return {"preparation": preparation, "area": area, "classes": classes, "source_texts": texts, "keywords": F.when(F.size(plants) > 0, plants).otherwise(fallback)}


TRANSLATIONS = [("en", fixed.TRANSLATE_ENGLISH), ("hi", fixed.TRANSLATE_HINDI), ("pa", fixed.TRANSLATE_PUNJABI), ("ml", fixed.TRANSLATE_MALAYALAM), ("ta", fixed.TRANSLATE_TAMIL)]


def translation_target(query: Column, english: Column) -> Column:
    """The language that a follow-up asks its last answer to be put into; null if it does not. Languages in order, and
    for each both wordings."""
    a, b = stripped(F.lower(query)), stripped(F.lower(F.coalesce(english, query)))
    out = F.lit(None).cast("string")
    for code, patterns in reversed(TRANSLATIONS):
        out = F.when(any_pattern(a, patterns) | any_pattern(b, patterns), F.lit(code)).otherwise(out)
    return out


def is_followup(query: Column) -> Column:
    q = stripped(F.lower(query))
    w = F.split(q, r"\s+")
    return any_pattern(q, fixed.FOLLOWUP_PATTERNS) | ((F.size(w) <= 8) & F.arrays_overlap(w, F.array(*map(F.lit, fixed.ANAPHORA))))


def in_context(query: Column, prior: Column, jurisdiction: Column) -> Column:
    """A follow-up question with the question before it; others as they are."""
    before = F.trim(F.regexp_replace(prior, "[?!.,]", ""))
    abroad = F.concat(query, F.lit(" (Prior subject: protection and patentability of "), before, F.lit(" under international treaties TRIPS CBD Nagoya Protocol WIPO GRATK)"))
    home = F.concat(query, F.lit(" (Prior subject from turn: "), before, F.lit(" patentability criteria comparison)"))
    return F.when(prior.isNotNull() & is_followup(query), F.when(F.lower(jurisdiction) == "international", abroad).otherwise(home)).otherwise(query)


def client_file(text: Column) -> Column:
    """The second resolver's file for a citation's text."""
    t, out = F.lower(text), F.lit(fixed.DEFAULT_FILE)
    for some, every, name in reversed(fixed.CLIENT_FILE_RULES):
        hit = any_word(t, some)
        for w in every:
            hit = hit & t.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def resolve_page(citations: DataFrame, registry: DataFrame, file: str = "file", section: str = "section", key: str = "id") -> DataFrame:
    """citations with `page`: that of the whole section text, of its number, of the number's base, of the first
    registered key in the text, or else 1; null for an unknown file. registry(r_file, r_key, r_page, r_ord)."""
    s = F.trim(F.lower(F.col(section)))
    number = F.regexp_extract(s, r"(\d+[a-z]?(?:\([a-z0-9]+\))*|\b\d+[a-z]?\b)", 1)
    base = F.trim(F.regexp_replace(number, r"\(.*?\)", ""))
    x = citations.join(registry, F.col(file) == F.col("r_file"), "left")
    rank = F.when(F.col("r_key") == s, 1).when(F.col("r_key") == number, 2).when(F.col("r_key") == base, 3).when(s.contains(F.col("r_key")), 4).otherwise(5)
    n = F.row_number().over(Window.partitionBy(key).orderBy(rank, "r_ord"))
    page = F.when(F.col("r_file").isNull() | (F.col(section) == ""), None).when(rank < 5, F.col("r_page")).otherwise(1)
    return x.withColumn("page", page).withColumn("_n", n).where("_n = 1").select(*citations.columns, "page")


def resolve_citations(citations: DataFrame, aliases: DataFrame, files: DataFrame, urls: DataFrame, registry: DataFrame) -> DataFrame:
    """citations(id, source, section) with file, page, link and official url. The file is that of the first keyword in
    source and section, or the default; the url that of an alias equal to the source, or of the first keyword."""
    c = citations.withColumn("both", F.concat_ws(" ", "source", "section"))
    f = first_match(c, files, "both", "id").select("id", F.coalesce("file", F.lit(fixed.DEFAULT_FILE)).alias("file"))
    u = first_match(c, urls.withColumnRenamed("url", "found"), "both", "id").select("id", "found")
    x = c.join(f, "id").join(u, "id").withColumn("alias", F.trim(F.lower("source"))).join(aliases, "alias", "left")
    x = resolve_page(x.withColumn("section", F.coalesce("section", F.lit(""))), registry)
    anchor = F.when(F.col("page").isNotNull(), F.concat(F.lit("#page="), F.col("page").cast("string"))).otherwise("")
    link = F.concat(F.lit("/pdf/"), F.replace(F.url_encode("file"), F.lit("+"), F.lit("%20")), anchor)
    return x.select("id", "file", "page", link.alias("link"), F.coalesce("url", "found").alias("official_url"))


def tkdl_pointer(query: Column, classification: Column) -> Column:
    """Where to look for prior art, as a struct of hints; null where the question doesn't ask for it."""
    return F.when(tkdl_trigger(query, classification), F.struct(*(c.alias(n) for n, c in tkdl_hints(query).items())))


def last_wins(rows: DataFrame, aliases: list[str], value: str, order: str) -> DataFrame:
    """alias -> value of the last row that has it, in any of the alias columns, lower-cased; blanks are none."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.trim(F.lower(F.col(a))).alias("alias")) for i, a in enumerate(aliases))))
    x = rows.select(F.col(order).alias("_o"), F.col(value).alias("_v"), each.alias("a")).where("a.alias <> ''")
    return x.groupBy(F.col("a")["alias"].alias("alias")).agg(F.max_by("_v", F.struct("_o", F.col("a")["i"])).alias(value))


def confidence(top_score: Column, threshold: float = 0.30) -> Column:
    """abstained: nothing found, or the best score under the threshold."""
    return top_score.isNull() | (top_score < threshold)


def relevance_tier(score: Column) -> Column:
    return F.when(score >= 0.80, "Critical Statutory Grounding").when(score >= 0.40, "High Statutory Relevance").otherwise("Contextual Legal Anchor")


def latency_tier(ms: Column) -> Column:
    return F.when(ms < 2000, "latency-fast").when(ms < 5000, "latency-mid").otherwise("latency-slow")


def display_score(top: Column) -> Column:
    """A display value in [92, 99.9]; it measures nothing."""
    x = F.when(top > 1.0, 99.4).when(top > 0.8, 92.0 + top * 7.5).when(top > 0.4, 88.0 + top * 10.0).otherwise(95.0)
    return F.least(F.lit(99.9), F.greatest(F.lit(92.0), F.bround(x, 1)))


def template_answer(chunks: Column) -> Column:
    """An answer text from ranked chunks (array<struct<title, section, text, score>>)."""
    cite = F.transform(chunks, lambda c: F.concat(F.lit("["), c["title"], F.lit("] "), c["section"]))
    lead = truncated(stripped(chunks[0]["text"]), 300, 297)
    others = F.when(F.size(cite) > 1, F.array_join(F.slice(cite, 2, 2), ", ")).otherwise("None")
    return F.concat(F.lit("According to "), cite[0], F.lit(':\n"'), lead, F.lit('"\n\nAdditional applicable authorities include: '), others, F.lit("."))


def context_block(chunks: Column) -> Column:
    """Numbered sources for a prompt."""
    one = lambda c, i: F.concat(F.lit("Source ["), (i + 1).cast("string"), F.lit("] (["), c["title"], F.lit("] "), c["section"], F.lit("):\n"), c["text"])
    return F.array_join(F.transform(chunks, one), "\n\n")
