"""Languages of texts by rank-ordered profiles of character grams, for those that no script of their own tells.

A profile lists the GRAMS most frequent runs of one to three characters, in order. The profile of a language is that of a
bounded sample of labelled texts, SAMPLE of each label, those whose hashes come first. A text gets the label whose profile
its own is nearest to: by the sum, over its grams, of how far each is from its place there, GRAMS if it is not there.

Defined results: letters are taken in lower case and everything else as one space; a text without letters, or null, has no
profile and no label; texts are read whole; ties go to the first label in order; without any labelled text nothing has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_language

GRAMS = 300
SAMPLE = 200
#: Letters and spaces of a text that are counted at once.
_BLOCK = 1 << 20


def profile(texts: list[str]) -> np.ndarray:
    """The grams of texts, as numbers, from the most frequent one on; among equally frequent ones the smaller first."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64) if words else np.zeros(0, np.int64)
        for at in range(0, len(codes), _BLOCK):
            c = codes[at : at + _BLOCK + 2]
            found = [c[:_BLOCK][c[:_BLOCK] != 32], c[:_BLOCK][: max(len(c) - 1, 0)] << 21 | c[1 : _BLOCK + 1], c[: max(len(c) - 2, 0)] << 42 | c[1 : max(len(c) - 1, 1)] << 21 | c[2:]]
            here, n = np.unique(np.concatenate(found), return_counts=True)
            both = np.concatenate([grams, here])
            grams, at_each = np.unique(both, return_inverse=True)
            counts = np.bincount(at_each, np.concatenate([counts, n])).astype(np.int64)
    return grams[np.lexsort((grams, -counts))][:GRAMS]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The profile of each label, GRAMS numbers, on the driver."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), F.xxhash64("text", F.lit(1))))

    def of_label(t: pa.Table) -> pa.Table:
        return pa.table({"label": t["label"][:1], "grams": pa.array([profile(t["text"].to_pylist()).tolist()], pa.list_(pa.int64()))})

    sampled = rows.withColumn("_n", n).where(F.col("_n") <= sample).drop("_n")
    found = sampled.groupBy("label").applyInArrow(of_label, "label string, grams array<bigint>").collect()
    return {r["label"]: np.array(r["grams"], np.int64) for r in sorted(found, key=lambda r: r["label"]) if r["grams"]}


def distance(own: np.ndarray, grams: np.ndarray, ranks: np.ndarray) -> int:
    """How far the grams of a text are from their places in a profile, given as sorted grams with their ranks."""
    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    there = grams[at] == own
    return int(np.where(there, np.abs(ranks[at] - np.arange(len(own))), GRAMS).sum())


def nearest(text: Column, profiles: dict[str, np.ndarray]) -> Column:
    """The label of the profile that text is nearest to, null if it has no letters."""
    known = [(label, np.sort(p), np.argsort(p, kind="stable")) for label, p in profiles.items()]

    def run(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for t in texts.to_pylist():
            own = profile([t]) if t else np.zeros(0, np.int64)
            out.append(min(known, key=lambda k: distance(own, k[1], k[2]))[0] if len(own) and known else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


def detect(text: Column, profiles: dict[str, np.ndarray], default: str = "en") -> Column:
    """The language of a script of its own, where a text has one; else that of the nearest profile; else the default."""
    script = F.nullif(detect_language(text), F.lit("en"))
    return F.coalesce(script, nearest(text, profiles), F.lit(default))
