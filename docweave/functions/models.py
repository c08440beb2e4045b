"""Model boundaries: embedding, pair scoring, generation, translation, as batched functions over Arrow.

A model is a callable factory, built once in each worker: `lambda: model` where model(list[str]) returns one result per
text. Without one, deterministic stand-ins take its place, so that plans run and can be checked.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 64
BATCH, SMALLER_BATCH = 32, 8


class _Places(dict):
    """Where a word counts: its dimension, and so many more if it counts against it. Words are hashed when they come up first."""

    #: Words after which all are forgotten.
    most = 1 << 17

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest())
        place = self[word] = h % self.dimension + (0 if h >> 63 else self.dimension)
        return place


_places = functools.cache(_Places)


def stand_in_embedding(texts: list[str], dimension: int = DIMENSION) -> list[list[float]]:
    """Unit vectors of signed, hashed word counts."""
    out, places = [], _places(dimension)
    for t in texts:
        if len(places) > places.most:
            places.clear()
        found = list(map(places.__getitem__, (t or "").lower().split()))
        counts = np.bincount(np.array(found, int), minlength=2 * dimension).astype(float)
        v = counts[:dimension] - counts[dimension:]
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def stand_in_score(queries: list[str], texts: list[str]) -> list[float]:
    """Shared words less a penalty for length."""
    return [len(set((q or "").lower().split()) & set((t or "").lower().split())) - len(t or "") / 1000 for q, t in zip(queries, texts, strict=True)]


def _in_batches(model: Callable, *columns: list) -> list:
    """The model over batches; a batch that doesn't fit its memory is tried again in smaller ones."""
    out = []
    for i in range(0, len(columns[0]), BATCH):
        part = [c[i : i + BATCH] for c in columns]
        try:
            out += model(*part)
        except MemoryError:
            for j in range(0, len(part[0]), SMALLER_BATCH):
                out += model(*(c[j : j + SMALLER_BATCH] for c in part))
    return out


def embed(text: Column, factory: Callable[[], Callable] | None = None) -> Column:
    built: list[Callable] = []

    def run(t: pa.Array) -> pa.Array:
        if not built:
            built.append(factory() if factory else stand_in_embedding)
        return pa.array(_in_batches(built[0], t.to_pylist()), pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(text)


def cross_encode(query: Column, text: Column, factory: Callable[[], Callable] | None = None) -> Column:
    built: list[Callable] = []

    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        if not built:
            built.append(factory() if factory else stand_in_score)
        return pa.array(_in_batches(built[0], q.to_pylist(), t.to_pylist()), pa.float64())

    return F.arrow_udf(run, "double")(query, text)


def is_rate_limit(message: str) -> bool:
    """Whether a provider's error asks to try the next model rather than to give up."""
    m = message.lower()
    return any(w in m for w in ("429", "rate limit", "rate_limit", "tpm", "rpm"))


def complete(prompt: Column, factory: Callable[[], list[Callable[[str], str]]]) -> Column:
    """A prompt's completion by the first provider that answers; null if all fail. Off unless a factory is given."""
    built: list[list[Callable[[str], str]]] = []

    def one(p: str | None) -> str | None:
        for provider in built[0]:
            try:
                return provider(p or "")
            except Exception:  # noqa: BLE001
                continue
        return None

    def run(p: pa.Array) -> pa.Array:
        if not built:
            built.append(factory())
        return pa.array([one(x) for x in p.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(prompt)


def translate(text: Column, source: Column, target: Column, factory: Callable[[], Callable[[str, str, str], str | None]] | None = None) -> Column:
    """A text in another language; itself where source and target agree, where there is no translator, or if it fails."""
    built: list[Callable] = []

    def run(t: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        if not built:
            built.append(factory() if factory else lambda *_: None)
        rows = zip(t.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([x if x is None or p == q else built[0](x, p, q) or x for x, p, q in rows], pa.string())

    return F.arrow_udf(run, "string")(text, source, target)
