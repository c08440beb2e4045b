"""The retrieval memo replayed over a request log: a cache that is emptied when a new key finds it full.

Which request empties it depends on all before it, yet the log is not folded in one task. From a request that begins an
epoch, the next one begins at the request that brings the (capacity + 1)-th distinct key, which follows from the log behind
alone. The log is cut into stretches. Of each, the first capacity + 1 distinct keys are kept, and merged with those of the
stretches behind by doubling, until all lists are full or at the log's end. With the list of what comes behind it, a stretch
knows where an epoch that begins in it hands over to a later stretch. The place is always one of the first capacity + 1
distinct keys there, so that these are all the edges, and those that are reached from the first request are found by
doubling too. A last pass marks the epochs within the stretches.

A task holds a stretch; work tables, each of at most capacity + 1 rows a stretch, are written to a folder that the executors
share. Stretches, a row each, are numbered in one task. Keys that are long had better be given as digests.

Defined results: orders are distinct and not null; a null key is a key like others; an empty log gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LIST = "array<struct<at:bigint,key:string>>"


def memo_key(query: Column, jurisdiction: Column, category: Column) -> Column:
    """What the memo tells requests apart by; numbers of candidates are not in it."""
    return F.concat_ws("\x1f", F.lower(F.trim(query)), F.lower(F.trim(jurisdiction)), F.coalesce(category, F.lit("\x1e")))


def _next(keys: list, n: int, capacity: int) -> list[int | None]:
    """For each of the first n places the one that an epoch from there ends at; None if it doesn't within keys."""
    held: dict = {}
    out, end = [], 0
    for start in range(n):
        while end < len(keys) and (keys[end] in held or len(held) < capacity):
            held[keys[end]] = held.get(keys[end], 0) + 1
            end += 1
        out.append(end if end < len(keys) else None)
        held[keys[start]] -= 1
        if not held[keys[start]]:
            del held[keys[start]]
    return out


def _stretch(log: pa.Table, behind: pa.Table, capacity: int) -> tuple[list, list, list]:
    """Orders and keys of a stretch and the list behind it, by order, and the next epoch from each place of the stretch."""
    log = log.sort_by("at")
    at, keys = log["at"].to_pylist(), log["key"].to_pylist()
    n = len(at)
    for entry in behind["behind"][0].as_py() or []:
        at.append(entry["at"])
        keys.append(entry["key"])
    return at, keys[:n], _next(keys, n, capacity)


def _doubled(lists: DataFrame, size: int, place: str) -> DataFrame:
    """lists(n, own) with the first distinct keys from stretch n on."""
    spark = lists.sparkSession
    total, step = lists.count(), 1
    merged = F.slice(F.concat("own", F.filter("later", lambda y: ~F.exists("own", lambda x: x["key"].eqNullSafe(y["key"])))), 1, size)
    while step < total and not lists.where((F.size("own") < size) & (F.col("n") + step < total)).isEmpty():
        later = lists.select((F.col("n") - step).alias("n"), F.col("own").alias("later"))
        x = lists.join(later, "n", "left").withColumn("later", F.coalesce("later", F.array().cast(_LIST)))
        x.select("n", merged.alias("own")).write.parquet(f"{place}/lists-{step}")
        lists = spark.read.parquet(f"{place}/lists-{step}")
        step *= 2
    return lists


def _reached(edges: DataFrame, first: int, place: str) -> DataFrame:
    """(at) of what is reached from first by edges(at, to), of which each place has one at most."""
    spark = edges.sparkSession
    reached, n, step = spark.createDataFrame([(first,)], "at bigint"), 1, 0
    while True:
        more = reached.join(edges, "at").select(F.col("to").alias("at"))
        reached.union(more).distinct().write.parquet(f"{place}/reached-{step}")
        reached = spark.read.parquet(f"{place}/reached-{step}")
        now = reached.count()
        if now == n:
            return reached
        n = now
        edges.join(edges.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")).write.parquet(f"{place}/edges-{step + 1}")
        edges, step = spark.read.parquet(f"{place}/edges-{step + 1}"), step + 1


def replay(requests: DataFrame, order: str, key: str, place: str, capacity: int = 512, width: int = 100_000) -> DataFrame:
    """requests(order, key), order a whole number, with `epoch`, the order of the request that its epoch begins with, and
    `hit`. width: orders of a stretch. place: a new folder for work tables."""
    size = capacity + 1
    log = requests.select(F.col(order).cast("bigint").alias("at"), F.col(key).cast("string").alias("key"))
    log = log.withColumn("stretch", F.floor(F.col("at") / width))
    log.groupBy("stretch", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).write.parquet(f"{place}/keys")
    keys = requests.sparkSession.read.parquet(f"{place}/keys")
    first = keys.agg(F.min("first")).first()[0]
    if first is None:
        return requests.select(order, key, F.lit(None).cast("bigint").alias("epoch"), F.lit(None).cast("boolean").alias("hit"))

    w = Window.partitionBy("stretch").orderBy("first")
    own = keys.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size)
    own = own.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("at"), "key"))).alias("own"))
    own.withColumn("n", F.row_number().over(Window.orderBy("stretch")) - 1).write.parquet(f"{place}/stretches")
    stretches = requests.sparkSession.read.parquet(f"{place}/stretches")
    lists = _doubled(stretches.select("n", "own"), size, place)
    behind = stretches.join(lists.select((F.col("n") - 1).alias("n"), F.col("own").alias("behind")), "n", "left").select("stretch", "own", "behind")

    def hand_over(_: tuple, log: pa.Table, behind: pa.Table) -> pa.Table:
        at, keys, then = _stretch(log, behind, capacity)
        n = len(keys)
        out: list = [None] * n
        for i in reversed(range(n)):
            out[i] = then[i] if then[i] is None or then[i] >= n else out[then[i]]
        entries = {x["at"] for x in behind["own"][0].as_py()}
        rows = [(at[i], at[out[i]]) for i in range(n) if out[i] is not None and at[i] in entries]
        return pa.table({"at": pa.array([a for a, _ in rows], pa.int64()), "to": pa.array([b for _, b in rows], pa.int64())})

    by_stretch = log.groupBy("stretch")
    by_stretch.cogroup(behind.groupBy("stretch")).applyInArrow(hand_over, "at bigint, to bigint").write.parquet(f"{place}/edges-0")
    entered = _reached(requests.sparkSession.read.parquet(f"{place}/edges-0"), first, place)
    entered = behind.join(entered.select(F.floor(F.col("at") / width).alias("stretch"), F.col("at").alias("entry")), "stretch", "left")

    def mark(_: tuple, log: pa.Table, behind: pa.Table) -> pa.Table:
        at, keys, then = _stretch(log, behind, capacity)
        entry = behind["entry"][0].as_py()
        start = at.index(entry) if entry is not None else None
        epoch, before, last = [], [], {}
        since = None
        for i, k in enumerate(keys):
            if i == start:
                since, start = at[i], then[i]
            epoch.append(since)
            before.append(last.get(k))
            last[k] = at[i]
        return pa.table({"at": at[: len(keys)], "key": pa.array(keys, pa.string()), "stretch": pa.array(log["stretch"].to_pylist(), pa.int64()), "epoch": pa.array(epoch, pa.int64()), "before": pa.array(before, pa.int64())})

    marked = by_stretch.cogroup(entered.groupBy("stretch")).applyInArrow(mark, "at bigint, key string, stretch bigint, epoch bigint, before bigint")
    marked.write.parquet(f"{place}/marked")
    marked = requests.sparkSession.read.parquet(f"{place}/marked")
    ends = marked.groupBy("stretch").agg(F.max("epoch").alias("epoch"))
    carried = F.last("epoch", ignorenulls=True).over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("stretch", carried.alias("carried"))
    earlier = keys.select("stretch", "key", F.lag("last").over(Window.partitionBy("key").orderBy("stretch")).alias("earlier")).where("earlier is not null")
    x = marked.join(ends, "stretch").alias("m").join(earlier.alias("e"), (F.col("m.stretch") == F.col("e.stretch")) & F.col("m.key").eqNullSafe(F.col("e.key")), "left")
    epoch = F.coalesce("epoch", "carried")
    hit = F.coalesce(F.coalesce("before", "earlier") >= epoch, F.lit(False))
    return x.select(F.col("at").alias(order), F.col("m.key").alias(key), epoch.alias("epoch"), hit.alias("hit"))
