"""Document fingerprints by winnowing.

Every K characters of a text have a rolling hash. Of each W neighbouring hashes the least is chosen, the rightmost one if
several are least, and what is chosen makes the fingerprint, each hash with the position of its characters. So two texts
that share K + W - 1 characters in a row share a hash, at positions which say where, and texts that share none of K
characters share none but by chance (hashes have 32 bits). Positions count code points. A text of fewer than K characters
is one gram, and one of fewer than W grams is one window.

`fingerprints` adds them to a table, row by row, without a shuffle. `compared` holds each document against its successor in
ascending order, and against the text that its last quarter makes with the successor's beginning. For that the documents
go once through a shuffle by ranges of their order; a range's first row goes to the range before as well, so that each
range is streamed by itself, two texts in memory at a time.

Defined results: a null text is an empty one; empty texts have empty fingerprints, and two of those are alike (1), one
and another text unlike (0); documents are in ascending order of identifier (null first), then of their text's hash, so
that repeated rows follow each other; a single document is its own successor; an empty table gives an empty one; other
columns stay in `fingerprints` and are left out in `compared`. Very long texts are hashed BLOCK characters at a time.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mixed, partitions

#: Characters of a gram and grams of a window, powers of two: 31 equal characters in a row are always found.
K, W = 16, 16
#: Characters hashed at once.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k neighbouring characters; the polynomial of twice as many comes from two neighbouring ones."""
    h, width, base = codes.astype(np.uint64), 1, _BASE
    while width < k:
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    return mixed(h) >> np.uint64(32)


def _chosen(hashes: np.ndarray, first: int, w: int) -> np.ndarray:
    """For each window its least hash, with the rightmost position, as hash << 32 | position; repeats are left out."""
    top = np.uint64((1 << 32) - 1)
    least = (hashes << np.uint64(32)) | (top - np.arange(first, first + len(hashes), dtype=np.uint64))
    if len(least) < w:
        return np.array([least.min()], np.uint64) ^ top
    width = 1
    while width < w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return least[np.concatenate([[True], least[1:] != least[:-1]])] ^ top


def winnow(text: str, k: int = K, w: int = W, block: int = BLOCK) -> np.ndarray:
    """The fingerprint in order of positions, as hash << 32 | position. k and w have to be powers of two."""
    codes = code_points(text)
    if not len(codes):
        return np.zeros(0, np.uint64)
    if len(codes) < k:
        whole = int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=4).digest(), "little")
        return np.array([whole << 32], np.uint64)
    windows = max(1, len(codes) - k - w + 2)
    parts = [_chosen(gram_hashes(codes[at : at + min(block, windows - at) + k + w - 2], k), at, w) for at in range(0, windows, block)]
    found = np.concatenate(parts)
    return found if len(parts) == 1 else found[np.concatenate([[True], found[1:] != found[:-1]])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the hashes of two fingerprints."""
    x, y = (np.unique(f >> np.uint64(32)) for f in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def written(fingerprint: np.ndarray) -> str:
    """hash:position, comma-joined, the hash as eight hexadecimal digits."""
    return ",".join(f"{f >> 32:08x}:{f & 0xFFFFFFFF}" for f in fingerprint.tolist())


_PART = pa.struct([("hash", pa.int64()), ("position", pa.int64())])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, w: int = W) -> DataFrame:
    """docs with the column `out`, an array of hashes with their positions."""
    bound_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        found = [winnow(t or "", k, w) for t in texts.to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        flat = np.concatenate([np.zeros(0, np.uint64), *found])
        parts = pa.StructArray.from_arrays([pa.array((flat >> np.uint64(32)).astype(np.int64)), pa.array((flat & np.uint64(0xFFFFFFFF)).astype(np.int64))], fields=list(_PART))
        return pa.ListArray.from_arrays(ends, parts)

    return docs.withColumn(out, F.arrow_udf(run, "array<struct<hash:bigint,position:bigint>>")(F.col(text)))


def alike(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints."""
    x, y = (F.array_distinct(F.transform(c, lambda p: p["hash"])) for c in (a, b))
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / every)


def edited(text: str, following: str) -> str:
    """text with the last quarter of its characters replaced by the first as many, or all, of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(firsts: list[tuple[int | None, int]]):
    """For a row's place in the order, its range, and the range before if it begins one."""
    order = [(f[0] is not None, f[0] or 0, f[1]) for f in firsts]

    def find(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        found = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
            key = (i is not None, i or 0, h)
            at = bisect.bisect_right(order, key) - 1
            here = {"range": at, "guest": False}
            found.append([here, {"range": (at - 1) % len(order), "guest": True}] if key == order[at] else [here])
        return pa.array(found, pa.list_(pa.struct([("range", pa.int32()), ("guest", pa.bool_())])))

    return F.arrow_udf(find, "array<struct<range:int,guest:boolean>>")


def _streamed(k: int, w: int):
    def result(now: tuple, following: tuple) -> dict:
        doc_id, text, own = now
        new = edited(text, following[1])
        other = winnow(new, k, w)
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": written(own),
            "edited_fingerprint": written(other), "near_edited": likeness(own, other), "near_next": likeness(own, following[2]),
        }

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((c, pa.float64()) for c in ("near_edited", "near_next"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = at = None
        for batch in batches:
            done: list[dict] = []
            for i, where, guest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "range", "guest")), batch.column("text"), strict=True):
                if where != at:  # what is held is a guest, whose own range goes on from it
                    held, at = None, where
                if guest and held is None:
                    continue  # a further copy of the guest
                row = (i, text.as_py(), None)
                row = (*row[:2], winnow(row[1], k, w))
                if held is not None:
                    done.append(result(held, row))
                held = None if guest else row
            yield pa.RecordBatch.from_pylist(done, kinds)

    return run


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and how alike it is to that and to its successor.

    The ranges are found by a sort of identifiers and hashes alone; the driver gets the first row of each. key: a long.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    x = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = x.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    dealt = x.select("doc_id", "hash").repartitionByRange(partitions(spark), "doc_id", "hash")
    firsts = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("doc_id", "hash")).alias("f"))
    firsts = [(r["f"]["doc_id"], r["f"]["hash"]) for r in firsts.collect()]
    if not firsts:
        return spark.createDataFrame([], _COMPARED)
    firsts.sort(key=lambda f: (f[0] is not None, f[0] or 0, f[1]))
    x = x.select("doc_id", "text", "hash", F.explode(_ranges(firsts)("doc_id", "hash")).alias("to")).select("doc_id", "text", "hash", "to.range", "to.guest")
    x = x.repartitionById(len(firsts), "range").sortWithinPartitions("range", "guest", "doc_id", "hash", "text")
    return x.select("doc_id", "range", "guest", "text").mapInArrow(_streamed(k, w), _COMPARED)


def op12(docs: DataFrame) -> DataFrame:
    return compared(docs)
