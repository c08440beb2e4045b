"""Splitters: sections, articles, sub-clauses, and by size.

Matching positions are needed, which no built-in gives, so a text is split in one Python pass that returns its chunks
as an array; everything around it is a column expression. Defined results: null and blank texts have no chunks.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

# The patterns by which headings, clauses and footnotes are known, and the size splitter's separators.
ARTICLE = re.compile(r"(?im)^(?:\s*(?:ARTICLE|Article|Art\.)\s+(\d+[A-Za-z]?)(?:[\.\:\s—–\-]*\n*\s*([A-Z][^\n]{2,80}))?)")
TREATY = re.compile(r"(?im)^\s*(?:ARTICLE|Article)\s+\d+")
SECTION = re.compile(
    r"(?m)(?:^|\n\s*)((?:Section|Sec\.)\s+\d+[A-Za-z]?(?:[\.\:\—–\-]+|\s+[A-Z][^\n]{2,80})"
    r"|(?:Rule|Regulation|Reg\.)\s+\d+[A-Za-z]?(?:[\.\:\—–\-]+|\s+[A-Z][^\n]{2,80}|\b)"
    r"|\b\d+[A-Za-z]?\.\s+[A-Z][^\n]{2,80})"
)
SUBCLAUSE = re.compile(r'(?im)(?:^|\n\s*)(\([a-z0-9]{1,3}\))\s*(?:["“]([^"”\n]+)["”])?')
HEADING = re.compile(r"^((?:Section|Sec\.|Rule|Regulation|Reg\.)\s+\d+[A-Za-z]?|\d+[A-Za-z]?)(?:[\.\:\—–\-\s]+([^—–\(\n]+))?")
FOOTNOTES = [re.compile(p) for p in (r"\b\d+\[", r"(?m)^\s*\d+\[", r"\[\s*\d+\s*\]", r"(?m)^\s*\d+\.\s+(?:Subs\.|Ins\.|Omitted|Added)\s+by\s+.*$")]
#: What every match of the patterns above has some of: a text without it is not searched. Of words in either case these are
#: parts without i, k and s, which have other letters as their other case.
FOOTNOTE_SIGNS = [("[",), ("[",), ("[",), ("Subs.", "Ins.", "Omitted", "Added")]
TREATY_SIGN, BODY_SIGNS = "cle", ("chapter", "prel", "hort")
BODY = re.compile(r"(?im)(?:^|\n\s*)(?:CHAPTER\s+I\b|PRELIMINARY\b|(?:Section\s+1|1)\.\s+Short\s+title)")
PREAMBLE = "Preamble / Preliminary"
CLAUSE_PREAMBLE = "(Preamble/Definitions)"
SEPARATORS = ("\n\n", "\n", "; ", ". ", " ", "")
SIZE, OVERLAP = 1400, 150
#: Texts of a batch that are split at once.
SLICE = 100
_TRAIL = ".:—– "

Chunk = tuple[str, str]


def by_size(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped pieces of at most size characters where the separators allow it.

    The text is cut before each place of the first separator that it has, the empty one cutting everywhere. Parts of size
    characters or more are cut on by the separators after that; neighbours that are shorter are packed.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    places = [0, *(m.start() for m in re.finditer(re.escape(sep), text)), len(text)] if sep else range(len(text) + 1)
    parts = [text[a:b] for a, b in itertools.pairwise(places) if a < b]
    out: list[str] = []
    for short, run in itertools.groupby(parts, lambda p: len(p) < size):
        if short:
            out += _packed(list(run), size, overlap)
        else:
            out += itertools.chain.from_iterable(by_size(p, size, overlap, finer) if finer else [p] for p in run)
    return out


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Windows over parts: each as long as fits, and beginning with the last parts of the one before, of at most overlap
    characters, that leave room for the next part."""
    ends = list(itertools.accumulate(map(len, parts), initial=0))
    first, out = 0, []
    for last in range(len(parts)):
        if ends[last + 1] - ends[first] > size and first < last:
            out.append("".join(parts[first:last]).strip())
            while first < last and (ends[last] - ends[first] > overlap or ends[last + 1] - ends[first] > size):
                first += 1
    out.append("".join(parts[first:]).strip())
    return [p for p in out if p]


def _spans(text: str, marks: list[re.Match], least: int = 50) -> list[tuple[re.Match | None, str]]:
    """The text from each mark to the next, after what comes before the first if that is long enough."""
    out: list[tuple[re.Match | None, str]] = []
    if marks[0].start() > least and len(head := text[: marks[0].start()].strip()) >= least:
        out.append((None, head))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return out + [(m, text[m.start() : e].strip()) for m, e in zip(marks, ends, strict=True)]


def _one_line(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def _cut(s: str, limit: int) -> str:
    return s if len(s) <= limit else s[: limit - 3] + "..."


def _without_footnotes(text: str) -> str:
    for p, signs in zip(FOOTNOTES, FOOTNOTE_SIGNS, strict=True):
        if any(s in text for s in signs):
            text = p.sub("", text)
    return text


def articles(text: str) -> list[Chunk]:
    """Articles of a treaty, with titles that stand on a line of their own put back to their numbers."""
    text = _without_footnotes(text)
    if "table of contents" in text[:3000].lower() and (m := re.compile(r"(?im)^\s*article\s+1\b").search(text, 400)):
        text = text[m.start() :]
    opening = text[:1000].lower()
    titles = fixed.NAGOYA_TITLES if "nagoya" in opening else fixed.CBD_TITLES if "biological diversity" in opening else []
    for title, number in titles:
        text = re.sub(rf"(?im)\n\s*Article\s*\n+\s*({re.escape(title)}[^\n]*)", rf"\nArticle {number}. \1", text)
    marks = list(ARTICLE.finditer(text))
    out = []
    for m, body in _spans(text, marks) if marks else []:
        if m is None:
            out.append((PREAMBLE, body))
            continue
        title = m[2] or ""
        if not title and (ahead := re.match(r"[A-Z\s,\-–()/]{2,80}", text[m.end() : m.end() + 120].strip())):
            title = ahead[0]
        title = _cut(_one_line(title).rstrip(_TRAIL), 60)
        out.append((f"Article {m[1]}" + (f": {title}" if title else ""), body))
    return out


def sections(text: str, strategy: str = "section") -> list[Chunk]:
    """Sections or rules of an act; short ones but the last are taken for entries of a table of contents."""
    whole, text = text, _without_footnotes(text)
    low = text.lower()
    body = BODY.search(text) if any(s in low for s in BODY_SIGNS) else None
    if body and body.start() > 300 and ("SECTIONS" in (head := text[: body.start()].upper()) or "ARRANGEMENT OF CLAUSES" in head):
        text = text[body.start() :]
    marks = list(SECTION.finditer(text))
    parts = _spans(text, marks) if marks else []
    rules = strategy.lower() in ("rule", "regulation")
    out = []
    for i, (m, piece) in enumerate(parts):
        if m is None:
            out.append((PREAMBLE, piece))
            continue
        if len(piece) < 80 and i + 1 < len(parts):
            continue
        marker = re.sub(r"[\[\]]", "", m[1].strip().rstrip(_TRAIL)).strip()
        h = HEADING.match(marker)
        if h:
            *word, number = h[1].split()
            title = (h[2] or "").strip().rstrip(_TRAIL)
            word = word[0] if word else None
            if word is None:
                word = "Rule" if rules or int(re.match(r"\d+", number)[0]) >= 100 and "Rules" in whole[:400] else "Section"
            word = {"Sec.": "Section", "Reg.": "Regulation"}.get(word, word)
            marker = f"{word} {number}" + (f" — {title}" if title else "")
        out.append((_cut(_one_line(marker), 75), piece))
    return out


_DEFINING = ("Section 2", "Section 3", "Rule 2", "Rule 3", "Definitions", "NOT PATENTABLE")


def subclauses(section: str, text: str, least: int = 60) -> list[Chunk] | None:
    """One chunk for each lettered clause of a section of definitions or exclusions; None if it is not one."""
    marks = list(SUBCLAUSE.finditer(text))
    if len(marks) < 3 or not any(d in section for d in _DEFINING):
        return None
    base = re.search(r"(?i)\b(?:Section|Rule|Article|Regulation)\s+\d+[A-Za-z]?", section)
    parent = base[0] if base else section
    defines = "2" in parent or "Definitions" in section
    both = f"{section} {text}".lower()
    excludes = "not patentable" in both or "section 3" in section.lower() and "invention" in text.lower()
    lead = "(1) In this Act, unless the context otherwise requires,—\n" if defines else "The following are not inventions within the meaning of this Act,—\n" if excludes else ""
    out = []
    for m, body in _spans(text, marks, 0):
        if len(body) < least:
            continue
        if m is None:
            out.append((f"{parent} {CLAUSE_PREAMBLE}", body))
            continue
        letter = m[1].strip("()")
        name = f"{parent}(1)({letter})" + (f' "{m[2]}"' if m[2] else "") if defines else f"{parent}({letter})"
        out.append((name, f"{section}\n{lead}{body}".strip()))
    return out


def chunk(text: str | None, strategy: str | None = "section", most: int = 5000, least: int = 60) -> list[Chunk]:
    """(section, text) chunks of a document: its articles or sections, clauses of defining ones, and parts by size."""
    if not text or not text.strip():
        return []
    strategy = strategy or "section"
    treaty = strategy.lower() in ("article", "treaty") or TREATY_SIGN in text.lower() and TREATY.search(text)
    found = articles(text) if treaty else sections(text, strategy)
    if not found:
        return [(f"General (Part {i})", p) for i, p in enumerate(by_size(text), 1) if len(p) >= least]
    out: list[Chunk] = []
    for section, body in found:
        clauses = subclauses(section, body, least)
        if clauses is not None:
            for name, piece in clauses:
                parted = len(piece) > most and not name.endswith(CLAUSE_PREAMBLE)
                out += [(f"{name} (Part {i})", p) for i, p in enumerate(by_size(piece), 1)] if parted else [(name, piece)]
            continue
        parts = by_size(body) if len(body) > most else [body]
        for i, p in enumerate(parts, 1):
            if len(p) >= least:
                name = f"{section} (Part {i})" if len(parts) > 1 else section
                out.append((name, p if p.startswith(section) else f"{section}\n{p}"))
    return out


_CHUNKS = "array<struct<section:string,text:string>>"


def _chunk_udf(split):
    def run(text: pa.Array, strategy: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("section", pa.string()), ("text", pa.string())]))
        done = [pa.array([], kind)]
        # a batch may have thousands of texts; of SLICE at a time there are Python objects
        for i in range(0, len(text), SLICE):
            some = zip(text.slice(i, SLICE).to_pylist(), strategy.slice(i, SLICE).to_pylist(), strict=True)
            done.append(pa.array([[{"section": a, "text": b} for a, b in split(t, s)] for t, s in some], kind))
        return pa.concat_arrays(done)

    return F.arrow_udf(run, _CHUNKS)


def split_documents(docs: DataFrame, text: str = "text", strategy: Column | None = None, split=chunk) -> DataFrame:
    """docs without the text, with a row for each chunk: chunk_idx from 0, section, text."""
    found = _chunk_udf(split)(F.col(text), strategy if strategy is not None else F.lit("section"))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(found).alias("chunk_idx", "_c")).select(*rest, "chunk_idx", F.col("_c")["section"].alias("section"), F.col("_c")["text"].alias("text"))


def passages(docs: DataFrame, text: str = "text", block: int = 40, blocks: int = 5, shared: int = 1) -> DataFrame:
    """docs without the text, with a row for each passage of overlapping words: passage from 0, n_words, text.

    Built-ins only. A text is cut into blocks of so many words; a passage is some blocks in a row and begins with the last
    ones of the passage before. Line ends within a passage stay. A null or blank text has one passage without words.
    """
    rest = [c for c in docs.columns if c != text]
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?:\S+\s*){{1,{block}}}"), F.lit(0))
    x = docs.select(F.struct(*rest).alias("row"), cut.alias("cut"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("cut") - shared, F.lit(1)), F.lit(blocks - shared))
    joined = F.transform(starts, lambda i: F.regexp_replace(F.array_join(F.slice("cut", i, blocks), ""), r"\s+$", ""))
    x = x.select("row", F.posexplode(joined).alias("passage", "text"))
    return x.select("row.*", "passage", F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n_words"), F.col("text").alias(text))
