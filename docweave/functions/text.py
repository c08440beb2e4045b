"""Text functions as column expressions: cleaning, tokens, citations, languages, keys.

Classes are written out ([\\p{L}\\p{N}_] for a word character) so that the JVM and an SQL oracle read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WORD = r"[\p{L}\p{N}_]"

# The citation forms that give tokens, and the steps of normalisation further down.
NESTED = r"(?:section\s*)?(\d+)\s*\(([0-9]+)\)\s*\(([a-z0-9]+)\)"
CLAUSE = r"(?:section\s*)?(\d+)\s*\(([a-z0-9]+)\)"
ARTICLE = r"(?:article|art\.?)\s*(\d+[a-z]?)"
RULE = r"(?:rule\s*)?(\d+)\s*[-_ ]\s*([a-z0-9]+)"
HYPHEN = r"\b(\d+)\s*[-_]\s*([a-z]+)\b"


def chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements, in order."""
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def clean_text(text: Column) -> Column:
    """Control characters to spaces, lines that are only page numbers emptied, line ends and blanks normalised."""
    x = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    x = F.regexp_replace(x, r"(?imd)^\s*(?:page\s+\d+(?:\s*(?:of|/)\s*\d+)?|\d+)\s*$", "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]{2,}|\t", " ")  # a single blank is not replaced by itself
    lines = F.transform(F.split(x, "\n"), stripped)
    return stripped(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def clean_footnotes(text: Column) -> Column:
    """Drops openers like `12[`, references like `[ 3 ]` and amendment lines."""
    return chain(text, [(r"\b\d+\[", ""), (r"(?md)^\s*\d+\[", ""), (r"\[\s*\d+\s*\]", ""), (r"(?md)^\s*\d+\.\s+(?:Subs\.|Ins\.|Omitted|Added)\s+by\s+.*$", "")])


BODY = r"(?imd)(?:^|\n\s*)(?:CHAPTER\s+I\b|PRELIMINARY\b|(?:Section\s+1|1)\.\s+Short\s+title)"


def drop_contents(text: Column) -> Column:
    """Drops what comes before the body if that starts after offset 300 and the head lists sections."""
    at = F.regexp_instr(text, F.lit(BODY))
    head = F.upper(F.substring(text, F.lit(1), at - 1))
    listed = head.contains("SECTIONS") | head.contains("ARRANGEMENT OF CLAUSES")
    return F.when((at > 301) & listed, F.substring(text, at, F.length(text))).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case words of two characters or more, and single letters a to p. Parentheses stay in words; repeats stay."""
    # a run of one character that is no such letter matches neither side, and longer runs are taken whole
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_()]{2,}|[a-p]"), F.lit(0))


def _family(text: Column, pattern: str, groups: int, sign: str, forms) -> Column:
    """sign: a simpler pattern that any match has in it, so that texts without it are passed over once instead of for each group."""
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), i + 1).alias(f"g{i}") for i in range(groups)))
    tokens = F.flatten(F.transform(found, lambda m: F.array(*forms(*(m[f"g{i}"] for i in range(groups))))))
    return F.when(text.isNull() | text.rlike(sign), tokens).otherwise(F.array().cast("array<string>"))


def statutory_tokens(text: Column) -> Column:
    """Synthetic tokens of citations, family by family, repeats kept."""
    t, c = F.lower(text), lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    return F.concat(
        _family(t, NESTED, 3, r"\d\s*\(", lambda a, b, d: [c("section ", a, "(", b, ")(", d, ")"), c(a, "(", b, ")(", d, ")"), c("section ", a, "(", b, ")"), c(a, "(", b, ")"), c("(", d, ")"), d]),
        _family(t, CLAUSE, 2, r"\d\s*\(", lambda a, b: [c("section ", a, "(", b, ")"), c(a, "(", b, ")"), c("section ", a), c("(", b, ")"), b]),
        _family(t, ARTICLE, 1, r"art(?:icle|\.)?\s*\d", lambda a: [c("article ", a), c("article", a), c("art ", a)]),
        _family(t, RULE, 2, r"\d\s*[-_ ]\s*[a-z0-9]", lambda a, b: [c("rule ", a, b), c(a, b), c(a, "-", b)]),
        _family(t, HYPHEN, 2, r"\d\s*[-_]\s*[a-z]", lambda a, b: [c(a, b), c(a, "-", b)]),
    )


def legal_tokens(text: Column) -> Column:
    """Citation tokens, then words."""
    return F.concat(statutory_tokens(text), words(text))


NORMALISE = [
    (r"(?i)\b(?:sec(?:tion)?\.?\s*)?(\d+)\s*\(([0-9]+)\)\s*\(([a-z0-9]+)\)", "Section $1($2)($3)"),
    (r"(?i)\b(?:sec(?:tion)?\.?\s*)?(\d+)\s*\(([a-z0-9]+)\)", "Section $1($2)"),
    (r"(?i)\b(?:rule\.?\s*)?(\d+)\s*[-_ ]\s*([a-z0-9]+)\b", "Rule $1$2"),
    (r"(?i)\b(?:art(?:icle)?\.?\s*)(\d+[A-Za-z]?)\b", "Article $1"),
    (r"(?i)\b(\d+)\s*[-_]\s*([a-z0-9]+)\b", "$1$2"),
]
#: The third step only where the word Rule or a hyphen says that it is one.
STRICT = [*NORMALISE[:2], (r"(?i)\brule\.?\s*(\d+)\s*[-_ ]?\s*([a-z]{1,2})\b", "Rule $1$2"), *NORMALISE[3:]]


def normalize_citations(text: Column, strict: bool = False) -> Column:
    return stripped(chain(text, STRICT if strict else NORMALISE))


def detect_language(text: Column) -> Column:
    """The block of the first character of a known Indic script decides; else en."""
    first = F.regexp_extract(text, "[ऀ-ॿ਀-੿஀-௿ഀ-ൿ]", 0)
    code = F.when(first == "", None)
    for low, high, name in (("ऀ", "ॿ", "hi"), ("਀", "੿", "pa"), ("஀", "௿", "ta"), ("ഀ", "ൿ", "ml")):
        code = code.when(first.between(low, high), name)
    return F.coalesce(code, F.lit("en"))


def ascii_letter_share(text: Column) -> Column:
    """Of all letters, the share that is ASCII; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / letters)


def canonical_source(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def truncated(text: Column, limit: int, keep: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def cache_key(query: Column, jurisdiction: Column, answers: Column, language: Column) -> Column:
    """A key that is equal for like questions; answers: their JSON with sorted names."""
    x = F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    x = chain(x, fixed.KEY_SYNONYMS)
    return F.sha2(F.concat_ws("|", x, F.lower(jurisdiction), answers, F.lower(language)), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """A version 5 UUID of name in a namespace, given as 32 hexadecimal digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


DNS = "6ba7b8109dad11d180b400c04fd430c8"


def searchable(title: Column, prefix: Column, section: Column, text: Column) -> Column:
    """Joined by single spaces; a blank part keeps its separator."""
    e = lambda c: F.coalesce(c, F.lit(""))
    s = F.lit(" ")
    return F.concat(e(title), s, e(prefix), s, e(section), s, e(text))


def rerank_text(title: Column, prefix: Column, section: Column, text: Column, limit: int = 750) -> Column:
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.concat(e(title), F.lit(" "), e(prefix), F.lit(" "), e(section), F.lit(": "), e(text)), 1, limit)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def speech_clean(text: Column) -> Column:
    return F.trim(chain(text, fixed.SPEECH_STEPS))


def unfenced(text: Column) -> Column:
    """Without code fences or triple quotes around it."""
    return stripped(F.regexp_replace(stripped(text), r"^(?:```[A-Za-z]*\n?|\"\"\")|(?:```|\"\"\")$", ""))


def parse_answer(raw: Column) -> Column:
    """struct<answer, citations, confidence, abstained> of a model's output: the whole as JSON, else its outermost
    braces, else the text itself as an answer of medium confidence."""
    schema = "answer string, citations array<struct<source:string,section:string>>, confidence string, abstained boolean"
    body = stripped(F.regexp_replace(stripped(raw), r"(?s)^```[^\n]*\n|\n\s*```\s*$", ""))
    valid = lambda t: F.when(F.get_json_object(t, "$").startswith("{"), F.from_json(t, schema))
    plain = F.struct(raw.alias("answer"), F.array().cast("array<struct<source:string,section:string>>").alias("citations"), F.lit("medium").alias("confidence"), F.lit(False).alias("abstained"))
    return F.coalesce(valid(body), valid(F.regexp_extract(body, r"(?s)\{.*\}", 0)), plain)


def word_batches(text: Column, size: int = 3) -> Column:
    """The words of text in groups, each joined by spaces."""
    w = F.split(text, " ")
    return F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
