"""Repeated substrings by common-prefix intervals over a sparse enhanced suffix array.

Every LENGTH-byte window has an anchor: the place of the smallest hash among its GRAM-byte substrings. Equal windows
have equal anchors at equal offsets, so that only suffixes at anchors are needed, about one in 70, and only those whose
substring is found more than once. They are dealt by that hash. For each hash the suffixes are sorted; a scan over the
sorted array with a stack gives its common-prefix intervals, the nodes of the interval tree. In each node the members
are sorted by what is left of them: where a run of members agrees in enough bytes to the left, and the run is neither
extended to the right by all (it lies in one child of the node) nor to the left (it agrees in one more byte), it is
a maximal repeat, with all its occurrences.

A context that is found again in the same task, by a 192-bit hash, repeats in whole; its places are decided there and
only the first is dealt on. Texts that are equal are one text, whose copies repeat as a whole. A hash with more than HOT
places is dealt by more context: of two equal windows either enough bytes from the anchor on agree, or enough bytes to
its left, so that each place goes to two smaller groups, by a hash of either side.

Defined results: null is an empty text; texts shorter than LENGTH bytes have no repeats; repeated rows are copies of each
other; an empty table gives none; other columns are ignored, whatever their names. Windows that overlap in one text
repeat each other like any others.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, chunks, materialize, mixed, partitions, release

LENGTH = 200
GRAM = 64
HOT = 100_000
_STEP = 1 << 20
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the substrings of gram bytes (a power of two) at all places of a byte array."""
    h, width, power = _TABLE[data], 1, _BASE
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    return mixed(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width consecutive keys."""
    n = len(keys)
    pad = -n % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of the anchors of each text."""
    for start, stop in chunks(texts, _STEP):
        sizes = np.array([len(t) for t in texts[start:stop]])
        data = np.frombuffer(b"".join(texts[start:stop]), np.uint8)
        ends = np.cumsum(sizes)
        found = [], []
        # a long text is read in steps that overlap by a window less a byte
        for a in range(0, max(len(data) - length + 1, 0), _STEP * 2):
            part = data[a : a + _STEP * 2 + length - 1]
            h = gram_hashes(part, gram)
            keys = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
            least = (_least(keys, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
            at = np.arange(a, a + len(least))
            inside = np.searchsorted(ends, at, side="right") == np.searchsorted(ends, at + length - 1, side="right")
            least = least[inside]
            new = least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least
            found[0].append(h[new])
            found[1].append(new + a)
        hashes = np.concatenate(found[0]) if found[0] else np.zeros(0, np.uint64)
        places = np.concatenate(found[1]) if found[1] else np.zeros(0, np.int64)
        if len(places):
            places, first = np.unique(places, return_index=True)
            hashes = hashes[first]
        cuts = np.searchsorted(places, np.concatenate([[0], ends]))
        for k in range(len(sizes)):
            yield hashes[cuts[k] : cuts[k + 1]], places[cuts[k] : cuts[k + 1]] - (ends[k] - sizes[k])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - (((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) >> 3)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of a sorted array; lcp[i] is between i and i + 1. Children first."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            yield depth, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def group_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[int], int, int]]:
    """(members, bytes left of the anchor, bytes from it on) of the maximal repeats of `length` bytes or more.

    lefts are read outwards from the anchor, rights start with its substring.
    """
    order, lcp = _sorted(rights)
    for depth, first, last in intervals(lcp):
        need = length - depth
        child = [0]
        for x in lcp[first:last]:
            child.append(child[-1] + (x == depth))
        for run in _left_runs(order, first, last, lefts, need):
            same = [common(lefts[order[a]], lefts[order[b]]) for a, b in zip(run, run[1:], strict=False)]
            for left, a, b in intervals(same):
                if len({child[i - first] for i in run[a : b + 1]}) > 1:
                    yield [order[i] for i in run[a : b + 1]], left, depth


def _sorted(rights: list[bytes]) -> tuple[list[int], list[int]]:
    order = sorted(range(len(rights)), key=rights.__getitem__)
    return order, [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]


def _left_runs(order: list[int], first: int, last: int, lefts: list[bytes], need: int) -> Iterator[list[int]]:
    """The members of a node in runs that agree in `need` bytes to the left, each sorted by all bytes to the left."""
    if need <= 0:
        runs = [list(range(first, last + 1))]
    else:
        by: dict[bytes, list[int]] = {}
        for i in range(first, last + 1):
            if len(x := lefts[order[i]]) >= need:
                by.setdefault(x[:need], []).append(i)
        runs = [r for r in by.values() if len(r) > 1]
    for run in runs:
        run.sort(key=lambda i: lefts[order[i]])
        yield run


def cover(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """For each member, the (left, right) reaches of its maximal repeats that no other one's contain.

    In a node a member's longest maximal repeat is with the member of another child that agrees most to the left: with
    one of the same child the repeat is extended to the right by all, and it ends left where those two differ. In the
    order of left parts that member is the nearest one of another child, on either side.
    """
    reach: dict[int, list[tuple[int, int]]] = {}

    def put(m: int, left: int, right: int) -> None:
        mine = reach.setdefault(m, [])
        if not any(x >= left and y >= right for x, y in mine):
            mine[:] = [(x, y) for x, y in mine if x > left or y > right]
            mine.append((left, right))

    order, lcp = _sorted(rights)
    for depth, first, last in intervals(lcp):
        if last == first + 1:
            left = common(lefts[order[first]], lefts[order[last]])
            if left + depth >= length:
                put(order[first], left, depth)
                put(order[last], left, depth)
            continue
        child = list(itertools.accumulate((x == depth for x in lcp[first:last]), initial=0))
        for run in _left_runs(order, first, last, lefts, length - depth):
            same = [common(lefts[order[a]], lefts[order[b]]) for a, b in zip(run, run[1:], strict=False)]
            of = [child[i - first] for i in run]
            ahead = list(_diverse(same, of))
            back = list(_diverse(same[::-1], of[::-1]))[::-1]
            for i, left in zip(run, map(max, ahead, back), strict=True):
                if left >= 0 and left + depth >= length:
                    put(order[i], left, depth)
    return reach


def _diverse(same: list[int], of: list[int]) -> Iterator[int]:
    """For each member what it has in common with the nearest one before it of another child, -1 without one."""
    held = -1
    yield held
    for k, x in enumerate(same):
        held = x if of[k] != of[k + 1] else min(held, x)
        yield held


_ANCHORS = "array<struct<hash:bigint,places:array<int>>>"


def _anchor_udf(length: int, gram: int):
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("places", pa.list_(pa.int32()))]))

    def find(text: pa.Array) -> pa.Array:
        found = list(anchors(as_bytes(text), length, gram))
        if not any(len(h) for h, _ in found):
            return pa.array([[]] * len(text), kind)
        hashes = np.concatenate([h for h, _ in found]).view(np.int64)
        places = np.concatenate([p for _, p in found]).astype(np.int32)
        owner = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
        order = np.lexsort((places, hashes, owner))
        hashes, places, owner = hashes[order], places[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]))
        inner = pa.ListArray.from_arrays(pa.array(np.append(new, len(places)), pa.int32()), pa.array(places))
        values = pa.StructArray.from_arrays([pa.array(hashes[new]), inner], ["hash", "places"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[new], np.arange(len(found) + 1)), pa.int32()), values)

    return F.arrow_udf(find, _ANCHORS)


#: Rows with left and right: a context and where it stands. Rows without: a span from a to b, already decided.
_CONTEXT = "hash bigint, mark binary, a int, b int, left binary, right binary"
_SEEN = 100_000


def _contexts(length: int, gram: int, every: bool = False):
    """Context rows; with `every` for all places, else contexts seen again in a task are decided there."""
    side = length - gram
    ahead = gram + side // 2
    behind = length - ahead + 1

    def groups(hash: int, hot: bool, left: bytes, right: bytes) -> Iterator[int]:
        if not hot:
            yield hash
            return
        if len(right) >= ahead:
            yield xxhash.xxh3_64_intdigest(right[:ahead], seed=1) - (1 << 63)
        if len(left) >= behind:
            yield xxhash.xxh3_64_intdigest(left[-behind:] + right[:gram], seed=2) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], list] = {}
        rows: list[tuple] = []
        for batch in batches:
            marks, texts = batch.column("mark").to_pylist(), as_bytes(batch.column("text"))
            for mark, t, found in zip(marks, texts, batch.column("found").to_pylist(), strict=True):
                here = int.from_bytes(mark[:8], signed=True)
                for x in found:
                    for p in x["places"]:
                        left, right = t[max(0, p - side) : p], t[p : p + length]
                        first = None if every else seen.get(k := (x["hash"], _brief(left, right)))
                        if first is None:
                            if not every:
                                seen[k] = [mark, p]
                            rows += [(h, mark, p, p, left, right) for h in groups(x["hash"], x["hot"], left, right)]
                        elif len(left) + len(right) >= length:
                            # seen before in this task: both places repeat as far as the context goes
                            if first[0] is not None:
                                rows.append((here, first[0], first[1] - len(left), first[1] + len(right), None, None))
                                first[0] = None
                            rows.append((here, mark, p - len(left), p + len(right), None, None))
                    if len(rows) > 5000:
                        yield _batch(rows, _CONTEXT)
                        rows = []
                if len(seen) > _SEEN:
                    seen.clear()
        if rows:
            yield _batch(rows, _CONTEXT)

    return run


def _brief(left: bytes, right: bytes) -> bytes:
    return xxhash.xxh3_128_digest(right, seed=len(left)) + xxhash.xxh3_64_digest(left)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """(marks, places, lefts, rights) of each hash in turn, from batches sorted by hash; decided spans are left out."""
    last, held = None, None
    for batch in batches:
        batch = batch.filter(batch.column("right").is_valid())
        cols = [batch.column(c).to_pylist() for c in ("hash", "mark", "a", "left", "right")]
        h = batch.column("hash").to_numpy()
        cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = [c[a:b] for c in cols[1:]]
            if held is not None and cols[0][a] == last:
                for x, y in zip(held, part, strict=True):
                    x += y
            else:
                if held is not None:
                    yield tuple(held)
                held, last = part, cols[0][a]
    if held is not None:
        yield tuple(held)


_SPANS = "mark binary, a int, b int"
_REPEATS = "repeat string, length int, mark binary, start int"


def _spanner(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided: list[pa.RecordBatch] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                decided.append(batch.filter(batch.column("right").is_null()).select(["mark", "a", "b"]))
                yield batch

        out: list[tuple] = []
        for mark, place, left, right in _groups(watched()):
            yield from decided
            decided.clear()
            if len(mark) == 1:
                continue
            own: dict[tuple[bytes, bytes], list[int]] = {}
            for i, k in enumerate(zip(left, right, strict=True)):
                own.setdefault(k, []).append(i)
            distinct, members = list(own), list(own.values())
            reach = cover([x[::-1] for x, _ in distinct], [y for _, y in distinct], length) if len(distinct) > 1 else {}
            for k, ms in enumerate(members):
                x, y = len(distinct[k][0]), len(distinct[k][1])
                reaches = [(x, y)] if len(ms) > 1 and x + y >= length else reach.get(k, ())
                out += [(mark[m], place[m] - a, place[m] + b) for m in ms for a, b in reaches]
            if len(out) > 20_000:
                yield _batch(out, _SPANS)
                out = []
        yield from decided
        if out:
            yield _batch(out, _SPANS)

    return run


def _repeater(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, place, left, right in _groups(batches):
            for members, x, y in group_repeats([t[::-1] for t in left], right, length):
                m = members[0]
                name = hashlib.md5(left[m][len(left[m]) - x :] + right[m][:y]).hexdigest()
                yield _batch([(name, x + y, mark[i], place[i] - x) for i in members], _REPEATS)

    return run


_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class _Plan:
    """The tables that the operators below are made of."""

    def __init__(self, docs: DataFrame, key: str, text: str, length: int, gram: int, hot: int, every: bool = False) -> None:
        bound_batches(docs.sparkSession)
        n = partitions(docs.sparkSession)
        body = F.coalesce(F.col(text), F.lit(""))
        whole = docs.select(F.col(key).cast("bigint").alias("doc_id"), body.alias("text"))
        marked = whole.select("doc_id", F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("kid"), F.unhex(F.md5("text")).alias("mark"), "text")
        self.rows = materialize(marked.select("doc_id", "kid", "mark", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
        self.copies = materialize(self.rows.groupBy("mark").agg(F.min("kid").alias("kid"), F.count("*").alias("copies")), "copies")

        found = marked.where(F.octet_length("text") >= length).select("mark", F.explode(_anchor_udf(length, gram)(F.col("text"))).alias("x"))
        found = materialize(found.select(F.col("x.hash").alias("hash"), "mark", F.col("x.places").alias("places")), "places")
        filed = found.repartition(n, "hash")
        often = filed.groupBy("hash").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.max(F.size("places")).alias("most"), F.count("*").alias("n"))
        often = often.where("lo < hi OR most > 1").select("hash", (F.col("n") > hot).alias("hot"))
        again = filed.join(often.hint("shuffle_hash"), "hash")
        listed = again.groupBy("mark").agg(F.collect_set(F.struct("hash", "places", "hot")).alias("found"))
        self.listed = materialize(listed.join(self.copies.select("mark", "kid"), "mark"), "anchors")
        release(found)

        # The only shuffle of whole texts, by identifier, as copies of one text may be many. What is joined with it
        # below is dealt alike and of one plan, so that it is written once.
        self.texts = marked.select("kid", "mark", "text").repartition(n, "kid", "mark")
        listed = self.listed.select("kid", "mark", "found").hint("shuffle_hash")
        warm = self.texts.join(listed, ["kid", "mark"]).select("mark", "text", "found")
        self.contexts = warm.mapInArrow(_contexts(length, gram, every), _CONTEXT).repartition(n, "hash").sortWithinPartitions("hash")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(repeat, length, doc_id, start): the maximal repeats around anchors with all occurrences in distinct texts.

    A repeat that reaches beyond what is kept around an anchor appears as overlapping ones, and in the groups of a hot
    anchor one may appear with the occurrences of that group only.
    """
    p = _Plan(docs, key, text, length, gram, hot, every=True)
    out = p.contexts.mapInArrow(_repeater(length), _REPEATS)
    names = p.rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    return out.distinct().join(names, "mark").select("repeat", "length", "doc_id", "start")


def _cutter(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mark, t, spans in zip(batch.column("mark").to_pylist(), as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                kept, at, removed, n = [], 0, 0, 0
                for a, b in merged([(s["a"], s["b"]) for s in spans]):
                    kept.append(t[at:a])
                    at, removed, n = b, removed + b - a, n + 1
                raw = b"".join([*kept, t[at:]])
                rows.append((mark, removed, n, hashlib.sha256(raw).hexdigest(), raw if with_text else None))
            if rows:
                yield _batch(rows, _CUT)

    return run


_CUT = "mark binary, removed bigint, spans bigint, kept string, raw binary"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs; with_text adds `kept`, the bytes left
    where anything was removed."""
    p = _Plan(docs, key, text, length, gram, hot)
    spans = p.contexts.mapInArrow(_spanner(length), _SPANS)
    by_text = spans.groupBy("mark").agg(F.collect_list(F.struct("a", "b")).alias("spans")).join(p.copies.where("copies = 1").select("mark", "kid"), "mark")
    cut = p.texts.join(by_text.hint("shuffle_hash"), ["kid", "mark"]).select("mark", "text", "spans").mapInArrow(_cutter(with_text), _CUT)
    cut = materialize(cut, "cut")
    x = p.rows.join(p.copies.select("mark", "copies"), "mark").join(cut, "mark", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    pick = lambda a, b, c: F.when(whole, a).when(F.col("removed") > 0, F.col(b)).otherwise(c)
    zero = F.lit(0).cast("bigint")
    out = [
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "removed", zero).alias("n_removed"), pick(F.lit(1).cast("bigint"), "spans", zero).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept", F.col("sha")).alias("kept_sha256"),
    ]
    x = materialize(x.select(*out, *([F.when(whole, F.lit(b"")).otherwise(F.col("raw")).alias("kept")] if with_text else [])), "deduplicated")
    release(p.rows, p.copies, p.listed, cut)
    return x


def op6(docs: DataFrame) -> DataFrame:
    return dedup(docs)
