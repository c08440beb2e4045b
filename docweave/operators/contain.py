"""Joins on one text lying within another, by an index of character grams instead of a comparison of all pairs.

A text that lies in another has all its grams there too. Each part is filed under that of its grams which the fewest
wholes have, and meets only the wholes with that gram, of which the texts then decide. A part with a gram that no whole
has meets none. Grams are found in one pass over a text; of the wholes' only those that some part has go on.

Defined results: null and blank texts contain nothing and lie in nothing; a text lies in an equal one; case counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Of neighbouring characters the one before counts so many times.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: Column, n: int) -> Column:
    """All runs of n neighbouring characters, each once and as a number; none for null. Runs that had the same number would
    only make texts meet, which decide; a whole's numbers of several sizes have to be made distinct."""

    def one(t: str | None) -> np.ndarray:
        c = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
        key = np.zeros(max(0, len(c) - n + 1), np.uint64)
        for i in range(n if len(key) else 0):
            key = key * FACTOR + c[i : i + len(key)]
        return np.unique(key).view(np.int64)

    def run(texts: pa.Array) -> pa.Array:
        found = [one(t.as_py()) for t in texts]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))

    return F.arrow_udf(run, "array<bigint>")(text)


def _filled(rows: DataFrame, key: str, text: str, to: str) -> DataFrame:
    return rows.select(F.col(key).alias(to), F.col(text).alias(f"{to}_text")).where(F.trim(f"{to}_text") != "")


def contained(wholes: DataFrame, parts: DataFrame, whole: str, part: str, whole_text: str = "text", part_text: str = "text", gram: int = GRAM) -> DataFrame:
    """(whole, part): the keys of all pairs in which the part's text lies in the whole's. Keys should be unique."""
    w, p = _filled(wholes, whole, whole_text, "whole"), _filled(parts, part, part_text, "part")
    # a part shorter than a gram is a gram of its own length
    size = F.least(F.length("part_text"), F.lit(gram))
    own = F.element_at(F.array(*(_grams(F.col("part_text"), n) for n in range(1, gram + 1))), size)
    own = p.select("part", F.explode(own).alias("gram"))
    sizes = [r[0] for r in p.select(size).distinct().collect()]  # at most as many as a gram has characters
    every = _grams(F.col("whole_text"), max(sizes, default=gram))
    for n in sizes[:]:
        if n < max(sizes):
            every = F.array_union(every, _grams(F.col("whole_text"), n))
    known = w.select("whole", F.explode(every).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    times = known.groupBy("gram").agg(F.count("*").alias("times"))
    rarest = own.join(times, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("times", F.lit(0)), "gram")).alias("gram"))
    met = known.join(rarest, "gram").select("whole", "part")
    both = met.join(p, "part").join(w, "whole").where(F.col("whole_text").contains(F.col("part_text")))
    return both.select("whole", "part")


def either(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_text: str = "text", b_text: str = "text") -> DataFrame:
    """(a, b): the keys of all pairs of which one text lies in the other."""
    down = contained(a, b, a_key, b_key, a_text, b_text).select(F.col("whole").alias("a"), F.col("part").alias("b"))
    up = contained(b, a, b_key, a_key, b_text, a_text).select(F.col("part").alias("a"), F.col("whole").alias("b"))
    return down.unionByName(up).distinct()
