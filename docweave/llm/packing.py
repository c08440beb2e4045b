"""Cost-balanced packing of tokenised documents into sequences.

Documents are tokenised where they are read. Whole sequences' worth of a document becomes sequences of its own; what is
left of each document, fewer than `length` tokens, is packed: in descending order of length each goes to the sequence
of lowest estimated cost (linear plus quadratic in the length of each piece, as attention is within a document) that
has room for it, and what fits nowhere whole is cut to fill the room that remains. Sequences are laid out so that a
group's room equals its tokens: all are full, but for a last few whose lengths are the powers of two that make up the
remainder, so that nothing is padded.

The pieces are dealt evenly over the partitions, whatever their keys; each partition packs groups of GROUP documents
and numbers its own sequences.

Defined results: a null text is an empty one, which has the end token only; repeated rows are packed each on its own;
an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions

LENGTH = 1024
END = 0
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
GROUP = 16_384
#: A text with a longer run without a break, or of white space, is left to the library that handles such in n log n.
LONG_RUN = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Byte-level BPE ids of texts for a vocabulary file of the tokenizers library.

    The ids are those of that library. For speed they are made with tiktoken, which takes the same vocabulary; texts
    with special tokens or with very long runs go to the library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.path, self.library = path, None
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or len(text) > LONG_RUN and _longest_run(text) > LONG_RUN:
            found = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            found = self.fast.encode_to_numpy(text)
        out = np.empty(len(found) + 1, "<u4")
        out[:-1] = found
        out[-1] = END
        return out


def _longest_run(text: str) -> int:
    """The longest stretch without white space, or of white space."""
    longest = max(map(len, text.split()), default=0)
    return max(longest, max((m.end() - m.start() for m in re.finditer(r"\s{64,}", text)), default=0))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as it is, other bytes from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def layout(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of sequences that hold exactly total tokens: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in the piece, tokens, sequence, offset) for pieces of the given sizes, in descending order each.

    Sequences wait, by their room, until pieces are as short as that; so each piece looks only at those with room.
    """
    room = layout(sum(sizes), length)
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    for s in reversed(range(len(room))):
        waiting[room[s]].append(s)
    spent, used, out, cut = [0.0] * len(room), [0] * len(room), [], []
    heap: list[tuple[float, int]] = []
    shortest = length + 1

    def put(piece: int, start: int, n: int, s: int) -> None:
        out.append((piece, start, n, s, used[s]))
        used[s] += n
        room[s] -= n
        spent[s] += cost(n)

    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[piece]
        if not n:
            continue
        while shortest > n:
            shortest -= 1
            for s in waiting[shortest]:
                heapq.heappush(heap, (spent[s], s))
            waiting[shortest].clear()
        if not heap:
            cut.append(piece)
            continue
        _, s = heapq.heappop(heap)
        put(piece, 0, n, s)
        if room[s] >= shortest:
            heapq.heappush(heap, (spent[s], s))
        else:
            waiting[room[s]].append(s)
    left = [(spent[s], s) for s in range(len(room)) if room[s]]
    heapq.heapify(left)
    for piece in cut:
        start = 0
        while start < sizes[piece]:
            _, s = left[0]
            n = min(room[s], sizes[piece] - start)
            put(piece, start, n, s)
            start += n
            if room[s]:
                heapq.heapreplace(left, (spent[s], s))
            else:
                heapq.heappop(left)
    return out


_CODED = "doc_id bigint, doc_tokens bigint, crcs array<bigint>, body binary, tail binary"


def _coder(path: str, length: int, with_ids: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 512):
                rows = {"doc_tokens": [], "crcs": [], "body": [], "tail": []}
                for t in texts.slice(a, 512).to_pylist():
                    ids = tokens.ids(t or "")
                    full = len(ids) // length * length
                    rows["doc_tokens"].append(len(ids))
                    rows["crcs"].append([zlib.crc32(ids[i : i + length]) for i in range(0, full, length)])
                    rows["body"].append(ids[:full].tobytes() if with_ids else None)
                    rows["tail"].append(ids[full:].tobytes())
                kinds = {"doc_tokens": pa.int64(), "crcs": pa.list_(pa.int64()), "body": pa.binary(), "tail": pa.binary()}
                yield pa.RecordBatch.from_arrays([keys.slice(a, 512), *(pa.array(rows[k], kinds[k]) for k in kinds)], ["doc_id", *kinds])

    return code


def _packer(length: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == GROUP:
                    first = yield from group(held, first)
                    held = []
        if held:
            yield from group(held, first)

    def group(rows: list[dict], first: int):
        out = []
        for r in rows:
            for k, crc in enumerate(r["crcs"]):
                out.append((r["doc_id"], k * length, length, crc, r["doc_tokens"], first, 0, np.frombuffer(r["body"], "<u4")[k * length : (k + 1) * length] if with_ids else None))
                first += 1
        tails = [np.frombuffer(r["tail"], "<u4") for r in rows]
        last = -1
        for piece, start, n, s, offset in assign([len(t) for t in tails], length):
            r, ids = rows[piece], tails[piece][start : start + n]
            out.append((r["doc_id"], len(r["crcs"]) * length + start, n, zlib.crc32(ids.tobytes()), r["doc_tokens"], first + s, offset, ids if with_ids else None))
            last = max(last, s)
        for a in range(0, len(out), 20_000):
            cols = list(zip(*out[a : a + 20_000], strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in cols[7]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * with_ids)
        return first + last + 1

    return pack


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds its token ids. key has to be a long."""
    bound_batches(docs.sparkSession)
    x = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    coded = x.mapInArrow(_coder(vocabulary or default_vocabulary(), length, with_ids), _CODED)
    dealt = coded.repartition(partitions(docs.sparkSession)).sortWithinPartitions("doc_id", "doc_tokens", "tail")
    return dealt.mapInArrow(_packer(length, with_ids), ", ".join(f"{n} bigint" for n in NAMES) + ", ids array<int>" * with_ids)


def op8(docs: DataFrame) -> DataFrame:
    return pack(docs)
