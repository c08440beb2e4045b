"""Personal data: patterns, and terms that give protected entities away by corpus statistics.

An entity is one value of a base kind (an address, a number). Texts are cut into contexts: lines, and these into blocks
of BLOCK words. With p taken over all contexts of the corpus, a term t discloses an entity c as far as

    PMI(c; t) / IC(c) = log2(p(c, t) / (p(c) p(t))) / -log2 p(c)

nears 1, its value when t never occurs without c. Terms at or over DISCLOSURE are generalised, at or over REMOVAL
removed, wherever they stand. Only terms seen with an entity in MIN_SUPPORT different contexts are judged: equal
contexts, as copies of a text have them, count once there, since chance neighbours would else look like evidence.

Terms are words of three bytes or more, A-Z lower-cased, cut at ASCII punctuation; what base spans cover is no term.

The disclosing terms are sent to the executors as a set only if they are at most `most_broadcast`; beyond that the
texts' words are joined with them by a shuffle.

Defined results: null is an empty text without spans; repeated rows are judged alike; an empty table gives none;
other columns are left as they are (`sanitise`) or ignored (`find`), whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, release

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
_ORDER = {k: i for i, k in enumerate(KINDS + ACTIONS)}
BLOCK = 64
FLUSH = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPACED = bytes(c + 32 if 65 <= c < 91 else c if c == 10 or c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))
_WORD = re.compile(rb"[^ \n]+")

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Disclosure:
    threshold: float = 0.8
    removal: float = 0.95
    min_support: int = 3
    most_broadcast: int = 200_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A match is a run of local characters before an @ and a domain after it, so that only @ signs are looked at."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        last = m.end() if m else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Base spans ordered by start, then kind: leftmost and non-overlapping within a kind, failing matches dropped."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 60 else ""
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    found.sort(key=lambda x: (x[1], _ORDER[x[0]]))
    return found


def _masked(text: str, spans: list[Span]) -> bytes:
    """The text's terms, with everything else, base spans too, as spaces; as many bytes as the text has."""
    if spans:
        parts, at = [], 0
        for _, a, b in spans:
            if b > at:
                a = max(a, at)
                parts += [text[at:a], " " * len(text[a:b].encode())]
                at = b
        text = "".join([*parts, text[at:]])
    return text.encode(errors="replace").translate(_SPACED)


def _entity(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value.lower()}") - (1 << 63)


_COUNTS = "what string, entity bigint, kind string, term string, context bigint, n bigint"
_COUNTS_TYPE = pa.schema([("what", pa.string()), ("entity", pa.int64()), ("kind", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over contexts, of one partition in bounded parts: all, per term, per entity, per entity and term."""
    terms, rest = Counter(), Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [("term", None, None, t.decode(errors="replace"), None, n) for t, n in terms.items() if len(t) >= 3]
        rows += [(*k, n) for k, n in rest.items()]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 50_000], strict=True), _COUNTS_TYPE, strict=True)], schema=_COUNTS_TYPE)
        terms.clear()
        rest.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            flat = _masked(text, spans)
            blocks = 0
            if not spans:
                for line in flat.split(b"\n"):
                    words = line.split()
                    for i in range(0, len(words), BLOCK):
                        terms.update(set(words[i : i + BLOCK]))
                        blocks += 1
                        if len(terms) > FLUSH:
                            yield from flush()
            else:
                for entities, block in _contexts(text, flat, spans):
                    blocks += 1
                    inside = set(block)
                    terms.update(inside)
                    mark = xxhash.xxh64_intdigest(b" ".join(block)) - (1 << 63)
                    for kind, e in entities:
                        rest["entity", e, kind, None, None] += 1
                        for t in inside:
                            if len(t) >= 3:
                                rest["pair", e, kind, t.decode(errors="replace"), mark] += 1
                    if len(terms) + len(rest) > FLUSH:
                        yield from flush()
            rest["all", None, None, None, None] += blocks
            if len(terms) + len(rest) > FLUSH:
                yield from flush()
    yield from flush()


def _contexts(text: str, flat: bytes, spans: list[Span]) -> Iterator[tuple[set[tuple[str, int]], list[bytes]]]:
    """(entities, words) of each context. An entity belongs to the block of the words before it, or else after it."""
    at, byte, places = 0, 0, []
    for kind, a, b in spans:
        byte += len(text[at:a].encode(errors="replace"))
        at = a
        places.append((byte, kind, _entity(kind, text[a:b])))
    start = k = 0
    for line in flat.split(b"\n"):
        end = start + len(line)
        words = list(_WORD.finditer(line))
        blocks = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)] or [[]]
        for j, block in enumerate(blocks):
            stop = start + blocks[j + 1][0].start() if j + 1 < len(blocks) else end + 1
            entities = set()
            while k < len(places) and places[k][0] < stop:
                entities.add(places[k][1:])
                k += 1
            if block or entities:
                yield entities, [m[0] for m in block]
        start = end + 1


def disclosing_terms(docs: DataFrame, text: str = "text", how: Disclosure = Disclosure()) -> DataFrame:
    """A work table (term, kind, ratio, support, action): for each term that discloses an entity, the one it discloses most."""
    counts = materialize(docs.select(F.col(text).alias("text")).mapInArrow(_count, _COUNTS), "pii-counts")
    total = counts.where("what = 'all'").agg(F.sum("n").alias("total"))
    entities = counts.where("what = 'entity'").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    pairs = counts.where("what = 'pair'").groupBy("entity", "kind", "term", "context").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("entity", "kind", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("support")).where(F.col("support") >= how.min_support)
    terms = counts.where("what = 'term'").groupBy("term").agg(F.sum("n").alias("n_term"))
    x = pairs.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(total))
    content = F.log2(F.col("total") / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.col("total") / (F.col("n_entity") * F.col("n_term")))
    x = x.withColumn("ratio", F.when(content > 0, pmi / content)).where(F.col("ratio") >= how.threshold)
    best = x.groupBy("term").agg(F.max(F.struct("ratio", "support", "kind")).alias("m")).select("term", "m.*")
    out = materialize(best.withColumn("action", F.when(F.col("ratio") >= how.removal, "remove").otherwise("generalise")), "pii-terms")
    release(counts)
    return out


def _term_spans(text: str, spans: list[Span], wanted: dict[str, str] | None) -> Iterator[tuple[str, int, int]]:
    """(action, start, end) of the wanted terms, or (term, start, end) of all terms where wanted is None."""
    flat = _masked(text, spans)
    if wanted is not None and not any(w in wanted for w in {x.decode(errors="replace") for x in flat.split()}):
        return
    at = byte = 0
    raw = text.encode(errors="replace")
    for m in _WORD.finditer(flat):
        t = m[0].decode(errors="replace")
        if len(m[0]) >= 3 and (wanted is None or t in wanted):
            at += len(raw[byte : m.start()].decode(errors="replace"))
            byte = m.start()
            yield (t if wanted is None else wanted[t]), at, at + len(t)


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _rows(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def _finder(held=None):
    def find(text: pa.Array) -> pa.Array:
        wanted, out = held.value if held else {}, []
        for t in text.to_pylist():
            t = t or ""
            spans = base_spans(t)
            more = list(_term_spans(t, spans, wanted)) if wanted else []
            out.append(_rows(sorted([*spans, *more], key=lambda x: (x[1], _ORDER[x[0]]))))
        return pa.array(out, _SPANS_TYPE)

    return F.arrow_udf(find, _SPANS)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for mark, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = list(_term_spans(t or "", base_spans(t or ""), None))
            for i in range(0, len(rows), 50_000):
                term, start, end = zip(*rows[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([mark] * len(term)), pa.array(term), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["mark", "term", "start", "end"])


def find(docs: DataFrame, text: str = "text", spans: str = "_spans", how: Disclosure = Disclosure()) -> DataFrame:
    """docs with the column `spans`: base spans and those of disclosing terms, by start, then kind."""
    bound_batches(docs.sparkSession)
    terms = disclosing_terms(docs, text, how)
    if terms.limit(how.most_broadcast + 1).count() <= how.most_broadcast:
        held = docs.sparkSession.sparkContext.broadcast({r["term"]: r["action"] for r in terms.collect()})
        return docs.withColumn(spans, _finder(held)(F.col(text)))
    mark = F.md5(F.coalesce(F.col(text), F.lit("")))
    words = docs.select(mark.alias("mark"), F.col(text).alias("text")).mapInArrow(_words, "mark string, term string, start int, end int")
    found = words.join(terms.select("term", F.col("action").alias("kind")), "term").groupBy("mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_pii_more"))
    # empty texts have no terms; each has a key of its own, so that they don't meet in one task
    x = docs.withColumn("_pii_mark", F.when(F.octet_length(text) > 0, mark).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))).join(found.withColumnRenamed("mark", "_pii_mark"), "_pii_mark", "left")
    both = F.concat(_finder()(F.col(text)), F.coalesce("_pii_more", F.array().cast(_SPANS)))
    ordered = F.array_sort(both, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(_rank(a) - _rank(b)))
    return x.withColumn(spans, ordered).drop("_pii_mark", "_pii_more")


def _rank(span: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS + ACTIONS)), span["kind"]).cast("int")


def sanitise(docs: DataFrame, text: str = "text", how: Disclosure = Disclosure()) -> DataFrame:
    """docs with base spans as [email] and so on, generalised terms as [term], and removed ones taken out."""

    def cut(t: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for x, spans in zip(t.to_pylist(), s.to_pylist(), strict=True):
            if x is None or not spans:
                out.append(x)
                continue
            parts, at = [], 0
            for y in spans:
                if y["end"] > at:
                    parts.append(x[at : max(at, y["start"])])
                    parts.append({"generalise": "[term]", "remove": ""}.get(y["kind"], f"[{y['kind']}]"))
                    at = y["end"]
            out.append("".join([*parts, x[at:]]))
        return pa.array(out, pa.string())

    x = find(docs, text, "_pii_spans", how)
    return x.withColumn(text, F.arrow_udf(cut, "string")(F.col(text), F.col("_pii_spans"))).drop("_pii_spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    x = find(docs.select("doc_id", "text"), how=how)
    s = F.col("_spans")
    count = lambda k: F.size(F.filter(s, lambda y: y["kind"] == k)).cast("bigint")
    base = F.filter(s, lambda y: y["kind"].isin(*KINDS))
    return x.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"), (F.size(s) - F.size(base)).cast("bigint").alias("n_terms"))
