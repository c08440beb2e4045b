"""Similarity join on word shingles with parity sketches.

A text's set is its distinct WIDTH-word shingles, as 64-bit hashes. XORing a code of each shingle into a sketch keeps
parities only: what two sets share cancels out, so that sketches of sets differ in at most |A ^ B| places, and sets of
Jaccard similarity t have |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|).

Candidates. Sizes are put in bands of powers of two. In a band whose sets may differ in d shingles the sketch is dealt
into more than d + 1 chunks, so that linked sets agree in a chunk (pigeonhole). A chunk's content, held as the XOR of its
shingles' 64-bit codes, is a key. Keys are counted, and a set files itself under its d + 1 rarest ones, with d for its own
size: as at most d keys of a set are missing from a linked one, and all sets rank keys alike, linked sets meet in one of
those. Keys that one set only has come first in that order and need not be filed, so that what is filed are a set's
repeated keys but for its most frequent ones, as many as it has keys to spare; a passage that very many texts share
makes frequent keys, which go unused. Sets with too few filled chunks have keys for their empty ones too and spare none.
A set near a band's end also files with the next band.

Verification. Sets are nodes, so copies are one node. Under each key all nodes are first held against the smallest and the
largest one, a number of pairs that is linear in the bucket; sizes and the Hamming distance of sketches as wide as the
sets are large drop pairs that can't be linked, the whole sets decide the rest. Then, for buckets of three nodes or more
in different components only, all pairs of nodes of different components are held against each other, by size and
sketch within the bucket, in blocks of bounded size; only those that pass leave it. So no link between different
components is missed, while pairs within one are not all listed.

Defined results: null texts and texts without words have an empty set, link with nothing and are components of their
own; repeated rows are copies of one node; null identifiers do not name a component; other columns are ignored.
Two shingles, or two sets of one size, count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, as_bytes, bound_batches, chunks, materialize, mixed, release, small, window_hashes
from .graph import components

WIDTH = 5
PERCENT = 80
#: Nodes of one bucket on either side of a block of comparisons.
BLOCK = 4096


def most_apart(sizes: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes sum to `sizes`."""
    return (100 - percent) * sizes // (100 + percent)


def chunk_count(band: int, percent: int) -> int:
    """A quarter more than pigeonhole needs for the band's largest sets: what a set can spare."""
    d = most_apart(2 * ((2 << band) - 1), percent)
    return 5 * (d + 1) // 4 + 3


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes = WordHashes()
    for start, stop in chunks(texts):
        for t in texts[start:stop]:
            words = t.translate(LOWER).split()
            if not words:
                yield np.zeros(0, np.uint64)
            elif len(words) < width:
                yield np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
            else:
                yield np.unique(window_hashes(hashes.array(words), width))


def wide_sketch(hashes: np.ndarray) -> bytes:
    """Two to four parities for each member, 256 at least. XORing its halves makes it half as wide."""
    width = max(256, 4 << (max(len(hashes), 1).bit_length() - 1))
    odd = np.bincount((mixed(hashes) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def halved(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, in rows of 64-bit words, at a width of so many words."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches at the smaller one's width."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(halved(x, words) ^ halved(y, words)).sum())


def chunk_keys(hashes: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, int]]:
    """A set's keys and how many of them it can spare, in its own band and, if it files there, in the next one."""
    n = len(hashes)
    if not n:
        return [(np.zeros(0, np.uint64), 0)]
    band, largest = n.bit_length() - 1, 100 * n // percent
    found = []
    codes = mixed(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
    for b, most in ((band, min((2 << band) - 1, largest)), (band + 1, largest)):
        if b > band and largest < 2 << band:
            continue
        d = most_apart(n + most, percent)
        if d == 0:
            found.append((np.zeros(0, np.uint64), 0))  # only equal sets are linked, and those are one node
            continue
        k = chunk_count(b, percent)
        place = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        filled, spare = place[first], len(first) - d - 1
        content = np.bitwise_xor.reduceat(codes, first)
        if spare < 0:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), filled, assume_unique=True)
            filled, spare = np.concatenate([filled, empty]), 0
            content = np.concatenate([content, np.zeros(len(empty), np.uint64)])
        found.append((mixed(content + filled * np.uint64(0x9E3779B97F4A7C15) + np.uint64((b + 1) * 0xD6E8FEB86659FD93 % (1 << 64))), spare))
    return found


def _node(hashes: np.ndarray) -> int | None:
    """63 bits, so that another one says in which of a set's bands a key is."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)) >> 1 if len(hashes) else None


_SIGNED = "doc_id bigint, rid bigint, node bigint, n bigint, wide binary, spare array<int>, keys array<bigint>, own int"
#: Nodes that a signing task remembers, not to give the keys of copies again.
_REMEMBERED = 500_000


def _signer(width: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                nodes, sizes, wide, spare, keys, own, ends = [], [], [], [], [], [], [0]
                for h in shingle_sets(as_bytes(part.column("text")), width):
                    node = _node(h)
                    again = node is None or node in seen
                    if not again:
                        if len(seen) >= _REMEMBERED:
                            seen.clear()
                        seen.add(node)
                    bands = [] if again else chunk_keys(h, percent)
                    nodes.append(node)
                    sizes.append(len(h))
                    wide.append(None if again else wide_sketch(h))
                    spare.append(None if again else [s for _, s in bands])
                    keys.extend(k.view(np.int64) for k, _ in bands)
                    own.append(len(bands[0][0]) if bands else 0)
                    ends.append(ends[-1] + sum(len(k) for k, _ in bands))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                columns = [part.column("doc_id"), part.column("rid"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), pa.array(spare, pa.list_(pa.int32())), listed, pa.array(own, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "node", "n", "wide", "spare", "keys", "own"])

    return sign


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                found = [h.view(np.int64) for h in shingle_sets(as_bytes(part.column("text")), width)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "set"])

    return sets


def _checker(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy().view(np.uint64), b[i].values.to_numpy().view(np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return check


def _near(percent: int):
    """Of pairs with sizes and sketches, those that may be linked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            mask = pa.array([100 * min(i, j) >= percent * max(i, j) and distance(a, b) <= most_apart(i + j, percent) for i, j, a, b in zip(n, m, x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return check


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A work table of those pairs (a, b) of nodes whose whole sets are linked. Each node's set is made anew from one of its texts."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(wanted.join(nodes.select("node", "rid"), "node"), "wanted")
    texts = docs.join(small(wanted), "rid").select("node", "text")
    sets = materialize(texts.mapInArrow(_setter(width), "node bigint, set array<bigint>"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    found = materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(_checker(percent), "a bigint, b bigint").distinct(), "links")
    release(wanted, sets)
    return found


def _across(percent: int):
    """Pairs of nodes of different components that may be linked by size and sketch, from rows sorted by bucket and pair of blocks."""

    def pairs(held: list[pa.RecordBatch], one: int, two: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        node, root, block, n = (t[c].to_numpy() for c in ("node", "root", "block", "n"))
        wide = t["wide"].to_pylist()
        order = np.argsort(n, kind="stable")
        node, root, block, n = node[order], root[order], block[order], n[order]
        widths = np.array([len(wide[i]) // 8 for i in order])
        at = {w: np.array([halved(np.frombuffer(wide[i], np.uint64), w) for i in order[widths >= w]]) for w in np.unique(widths).tolist()}
        # sizes ascend, and so do widths: sketches of width w are those of the last nodes
        for i in range(len(n)):
            last = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
            other = np.arange(i + 1, last)
            other = other[root[other] != root[i]]
            if one != two:
                other = other[block[other] != block[i]]
            if not len(other):
                continue
            mine = at[int(widths[i])]
            skipped = len(n) - len(mine)
            apart = np.bitwise_count(mine[other - skipped] ^ mine[i - skipped]).sum(axis=1, dtype=np.int64)
            other = other[apart * (100 + percent) <= (100 - percent) * (n[i] + n[other])]
            if len(other):
                a, b = node[other], np.full(len(other), node[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            group = np.column_stack([batch.column(c).to_numpy() for c in ("key", "one", "two")])
            if not len(group):
                continue
            cuts = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(group)], strict=True):
                now = tuple(map(int, group[a]))
                if now != last and held:
                    yield from pairs(held, last[1], last[2])
                    held.clear()
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(held, last[1], last[2])

    return run


def _filed(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """A work table of (node, key): each set's rarest keys, as far as other sets have them too."""
    up = F.shiftleft("node", 1).bitwiseOR((F.col("pos") >= F.col("own")).cast("bigint"))
    keys = signed.select("node", "own", F.posexplode("keys").alias("pos", "key")).select(up.alias("member"), "key").repartition("key")
    times = keys.groupBy("key").agg(F.count("*").alias("times"), F.min("member").alias("lo"), F.max("member").alias("hi"))
    times = times.where(F.shiftrightunsigned("lo", 1) != F.shiftrightunsigned("hi", 1)).select("key", "times")
    repeated = keys.join(times.hint("shuffle_hash"), "key").select(F.shiftrightunsigned("member", 1).alias("node"), F.col("member").bitwiseAND(1).cast("int").alias("up"), "key", "times")
    repeated = materialize(repeated, "repeated")
    rarest = Window.partitionBy("node", "up").orderBy(F.desc("times"), F.desc("key"))
    spared = repeated.join(nodes.select("node", "spare"), "node").groupBy("node", "up", "key").agg(F.max("times").alias("times"), F.max(F.expr("spare[up]")).alias("spare"))
    filed = materialize(spared.withColumn("rank", F.row_number().over(rarest)).where("rank > spare").select("node", "key"), "filed")
    release(repeated)
    return filed


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs. key has to be a long."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # names a row where identifiers repeat or are null
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    spark = docs.sparkSession
    bound_batches(spark)
    signed = materialize(docs.mapInArrow(_signer(width, percent), _SIGNED), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(*(F.min(c).alias(c) for c in ("doc_id", "rid", "n", "wide", "spare")))
    nodes = materialize(nodes, "nodes")

    filed = _filed(signed, nodes)
    ends = filed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    buckets = materialize(filed.join(ends, "key"), "buckets")
    release(filed)

    stars = buckets.select("node", F.explode(F.array("lo", "hi")).alias("other")).where("node <> other")
    stars = stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(size), F.col("wide").alias(w)) for c, size, w in (("a", "n", "x"), ("b", "m", "y")))
    tested = materialize(stars.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_near(percent), "a bigint, b bigint"), "tested")
    links = _linked(tested, nodes, docs, width, percent)
    roots = components(links)

    placed = buckets.where("size > 2").join(small(roots), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    live = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    live = materialize(placed.join(live, "key"), "live")
    blocks = F.ceil(F.col("size") / BLOCK).cast("bigint")
    rows = live.join(nodes.select("node", "n", "wide"), "node").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "root", "block", "n", "wide")
    dealt = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    more = dealt.mapInArrow(_across(percent), "a bigint, b bigint").distinct().join(tested, ["a", "b"], "left_anti")
    more = materialize(more, "across")
    release(buckets, live, tested)
    if more.limit(1).count():
        further = _linked(more, nodes, docs, width, percent)
        release(roots)
        roots = components(links.unionByName(further))
        release(further)
    release(links, more)

    named = nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    # tables of their own, so that the rows of a very large component, or of very many copies, can be split in the joins
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    of_node = materialize(named.join(small(least), "root").select("node", "component_id"), "named")
    out = signed.select("doc_id", "node", "n").join(of_node, "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = materialize(out, "joined")
    release(signed, nodes, roots, least, of_node)
    return out


def op4(docs: DataFrame) -> DataFrame:
    return join(docs)
