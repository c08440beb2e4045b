"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words form one automaton. A document's words are streamed through it; at each word the state
tells the longest run of words that ends there and occurs in an item. Runs of WINDOW words or more are hits, and so
are whole items that are shorter. Words and word pairs that no item has end a run at once, so that only stretches of
known pairs, which are found for a block of documents at a time, go through the automaton.

The items are read in blocks of bounded size (BLOCK_BYTES of words), one after the other, each with an automaton of its
own; what the blocks find in a document is written and then merged. One block, the usual case, needs no shuffle.

Defined results: a null or empty text has no words, no hits and is clean; an item without words is no item; equal
items count each under its own identifier; null item identifiers count as the empty string; an empty benchmark leaves
every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, chunks, materialize

WINDOW = 13
#: A document is contaminated if hit words are this share of its words, as hit * SHARE >= words.
SHARE = 20
#: Hit spans of so many words are removed even from documents below the share.
MAX_SPAN = 50
#: About 370 MB in each Python worker, by 330,000 states and 185 MB for 2 MB of words.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and turns every ASCII byte that is neither digit nor letter into a space.
_WORD_BYTES = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word numbers, for items given as (identifier, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.numbers: dict[bytes, int] = {}
        coded = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: For a state, the items that have the window of WINDOW words which it stands for.
        self.windows: dict[int, set[str]] = {}
        #: For a state, the short items, as (words, identifier), that end there as a whole.
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.lengths = sorted({min(WINDOW, len(codes)) for _, codes in coded})
        for name, codes in coded:
            state = length = 0
            for c in codes:
                state, length = self.next[state][c], length + 1
                while self.length[self.link[state]] >= WINDOW:
                    state = self.link[state]
                if length >= WINDOW:
                    self.windows.setdefault(state, set()).add(name)
            if len(codes) < WINDOW:
                self.whole.setdefault(state, []).append((len(codes), name))
        self._above: dict[int, list[tuple[int, str]]] = {}
        pairs = {(a << 32) | b for _, codes in coded for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, edges: dict[int, int], link: int = 0) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _short(self, state: int) -> list[tuple[int, str]]:
        """The short items that are suffixes of what a state stands for."""
        found = self._above.get(state)
        if found is None:
            found = list(self.whole.get(state, ()))
            if self.link[state] > 0:
                found += self._short(self.link[state])
            self._above[state] = found
        return found

    def stream(self, codes: list[int], at: int) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit intervals of word positions, and the items found, for a stretch of known words that begins at `at`."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        for i, c in enumerate(codes, at + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state, matched = nxt[state][c], matched + 1
            if matched >= WINDOW:
                hits.append((i - matched, i))
                s = state
                while length[link[s]] >= WINDOW:
                    s = link[s]
                found |= self.windows[s]
            if self.whole and matched:
                for n, name in self._short(state):
                    if n <= matched:
                        hits.append((i - n, i))
                        found.add(name)
        return hits, found

    def match(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """(words, merged hit intervals, sorted items) for each text."""
        for start, stop in chunks(texts):
            lists = [words_of(t) for t in texts[start:stop]]
            counts = [len(w) for w in lists]
            get = self.numbers.get
            codes = np.fromiter((c for w in lists for c in map(get, w, repeat(-1))), np.int64, sum(counts))
            ends = np.cumsum(counts, dtype=np.int64)
            runs = self._runs(codes, ends)
            r = 0
            for k, n in enumerate(counts):
                first, hits, found = int(ends[k]) - n, [], set()
                while r < len(runs) and runs[r][0] < ends[k]:
                    a, b = runs[r]
                    h, f = self.stream(codes[a:b].tolist(), int(a) - first)
                    hits += h
                    found |= f
                    r += 1
                yield n, merged(hits), sorted(found)

    def _runs(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Stretches [from, to) long enough for a hit: within one text, all pairs of neighbours known to an item."""
        if not len(codes) or not self.lengths:
            return np.zeros((0, 2), np.int64)
        least = self.lengths[0]
        if least == 1:
            edge = np.diff(np.concatenate([[0], (codes >= 0).astype(np.int8), [0]]))
            runs = np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])
            return _cut(runs, ends)
        both = (codes[:-1] >= 0) & (codes[1:] >= 0)
        good = np.zeros(len(codes) - 1, bool)
        at = np.flatnonzero(both)
        if len(at) and len(self.pairs):
            keys = (codes[at] << 32) | codes[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            good[at] = self.pairs[place] == keys
        inner = ends[:-1] - 1
        inner = inner[(inner >= 0) & (inner < len(good))]
        good[inner] = False
        edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
        runs = np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1])
        return runs[runs[:, 1] - runs[:, 0] >= least]


def _cut(runs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs cut where a text ends."""
    points = np.unique(np.concatenate([runs.ravel(), ends]))
    edges = np.column_stack([points[:-1], points[1:]])
    inside = np.searchsorted(runs[:, 0], edges[:, 0], side="right") - 1
    keep = (inside >= 0) & (edges[:, 1] <= runs[np.maximum(inside, 0), 1]) if len(runs) else np.zeros(len(edges), bool)
    return edges[keep]


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "struct<n_words:bigint,hits:array<struct<a:bigint,b:bigint>>,items:array<string>>"
_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _finder(held):
    """A column function; held is a broadcast list of items, of which each worker builds the automaton once."""
    built: list[Automaton] = []

    def find(text: pa.Array) -> pa.Array:
        if not built:
            built.append(Automaton(held.value))
        rows = [{"n_words": n, "hits": [{"a": a, "b": b} for a, b in hits], "items": items} for n, hits, items in built[0].match(as_bytes(text))]
        return pa.array(rows, _FOUND_TYPE)

    return F.arrow_udf(find, _FOUND)


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks whose size is bounded: the block of an item comes from its hash, their number from the total."""
    x = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = x.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        part = x if n == 1 else x.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == b)
        yield [(r["item"], words_of(r["body"].encode())) for r in part.collect()]


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", found: str = "_found", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the struct column `found`: words, merged hit intervals (word positions, end exclusive) and item names.

    One block of items is held at a time. With more than one, the hits of each are written as a table, a row for each
    distinct text that has any, by a hash of it; these are grouped and joined with the documents.
    """
    bound_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    blocks = _blocks(items, item_key, item_text, block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return docs.withColumn(found, _finder(context.broadcast(block))(F.col(text)))
    mark = F.md5(F.col(text))
    hits = None
    while block is not None:
        held = context.broadcast(block)
        part = docs.where(F.octet_length(text) > 0).select(mark.alias("mark"), _finder(held)(F.col(text)).alias("f"))
        part = part.where(F.size("f.hits") > 0).groupBy("mark").agg(F.first("f").alias("f"))
        part = materialize(part.select("mark", "f.hits", "f.items"), "hits")
        held.destroy()
        hits = part if hits is None else hits.unionByName(part)
        block, more = more, next(blocks, None)
    by_mark = hits.groupBy("mark").agg(_merge_udf()(F.flatten(F.collect_list("hits"))).alias("_hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_hit_items"))
    by_mark = materialize(by_mark, "hits").withColumnRenamed("mark", "_hit_mark")
    # texts without words find nothing; each has a key of its own, so that they don't meet in one task
    own = docs.withColumn("_mark", F.when(F.octet_length(text) > 0, mark).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id())))
    both = own.join(by_mark, F.col("_mark") == F.col("_hit_mark"), "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>"), F.array().cast("array<string>")
    both = both.withColumn(found, F.struct(_count_udf()(F.col(text)).alias("n_words"), F.coalesce("_hit_spans", none[0]).alias("hits"), F.coalesce("_hit_items", none[1]).alias("items")))
    return both.select(*docs.columns, found)


def _count_udf():
    def count(text: pa.Array) -> pa.Array:
        return pa.array([len(words_of(t)) for t in as_bytes(text)], pa.int64())

    return F.arrow_udf(count, "bigint")


def _merge_udf():
    def merge(hits: pa.Array) -> pa.Array:
        rows = [[{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in h or ()])] for h in hits.to_pylist()]
        return pa.array(rows, _FOUND_TYPE.field("hits").type)

    return F.arrow_udf(merge, "array<struct<a:bigint,b:bigint>>")


def n_hit(found):
    return F.aggregate(found["hits"], F.lit(0).cast("bigint"), lambda s, h: s + h["b"] - h["a"])


def contaminated(found):
    hit = n_hit(found)
    return (hit > 0) & (SHARE * hit >= found["n_words"])


def remove_spans(text: str, hits: list[tuple[int, int]], longest: int) -> str:
    """text without the hit spans of `longest` words or more; the characters between its words go along."""
    raw = text.encode()
    flat = raw.translate(_WORD_BYTES)
    drop = [h for h in hits if h[1] - h[0] >= longest]
    if not drop:
        return text
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        ends.append(at := at + len(w))
    out, at = [], 0
    for a, b in drop:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def _remover(longest: int):
    def remove(text: pa.Array, hits: pa.Array) -> pa.Array:
        rows = [t if not h else remove_spans(t, [(x["a"], x["b"]) for x in h], longest) for t, h in zip(text.to_pylist(), hits.to_pylist(), strict=True)]
        return pa.array(rows, pa.string())

    return F.arrow_udf(remove, "string")


def _cleaner(held, longest: int):
    """Whether a text stays, and what is left of it, in one pass."""
    kind = pa.struct([("stays", pa.bool_()), ("text", pa.string())])
    built: list[Automaton] = []

    def clean(text: pa.Array) -> pa.Array:
        if not built:
            built.append(Automaton(held.value))
        rows = []
        for t, (n, hits, _) in zip(text.to_pylist(), built[0].match(as_bytes(text)), strict=True):
            hit = sum(b - a for a, b in hits)
            rows.append({"stays": not hit or SHARE * hit < n, "text": remove_spans(t, hits, longest) if hits else t})
        return pa.array(rows, kind)

    # else the filter below is pushed under the projection and each text is searched twice
    return F.arrow_udf(clean, "struct<stays:boolean,text:string>").asNondeterministic()


def clean(docs: DataFrame, items: DataFrame, text: str = "text", longest: int = MAX_SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents over the coverage limit go; from the others, hit spans of `longest` words or more are removed."""
    bound_batches(docs.sparkSession)
    blocks = _blocks(items, "item_id", "text", block_bytes)
    block = next(blocks)
    if next(blocks, None) is None:
        held = docs.sparkSession.sparkContext.broadcast(block)
        x = docs.withColumn("_clean", _cleaner(held, longest)(F.col(text)))
        return x.where(x["_clean"]["stays"]).withColumn(text, x["_clean"]["text"]).drop("_clean")
    x = find_hits(docs, items, text, block_bytes=block_bytes)
    x = x.where(~contaminated(x["_found"]))
    long = F.exists(x["_found"]["hits"], lambda h: h["b"] - h["a"] >= longest)
    return x.withColumn(text, F.when(long, _remover(longest)(F.col(text), x["_found"]["hits"])).otherwise(F.col(text))).drop("_found")


def op3(docs: DataFrame, items: DataFrame) -> DataFrame:
    x = find_hits(docs.select("doc_id", "text"), items)
    f = x["_found"]
    return x.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        n_hit(f).alias("n_hit"),
        F.size(f["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        contaminated(f).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(f["hits"], lambda h: h["b"] - h["a"])), F.lit(0).cast("bigint")).alias("longest_hit"),
    )
