"""Sharding by extendible hashing, in DataFrame operations.

A document's hash is read bit by bit. The directory starts as one bucket; a bucket over the byte limit is split on the
next bit, all others stay as they are, so that a shard is the shortest prefix whose documents fit. The bytes of all
prefixes come from one aggregate over cells of a few more bits than the shards need on average; documents of cells
that are still too large, few of them, go round again with more bits.

The first KEY_BITS bits are of the identifier. The rest are of the row's place, so that rows that share an identifier,
as repeated rows or nulls do, can be parted as well. Only a document that is larger than the limit by itself makes
a shard over the limit, which `oversized` tells.

Defined results: a null text has 0 bytes; an empty table has no shards; other columns are ignored in `assign` and kept
in `write`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, release

SHARD_BYTES = 8 << 20
KEY_BITS, PLACE_BITS = 48, 48
#: Bits of a cell beyond those that equal shards would need, and bits that each further round adds.
SPARE_BITS, MORE_BITS = 4, 12
MOST_FIRST_BITS = 20


def bits(key: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def _rows(docs: DataFrame, key: str, text: str, row: str | None) -> DataFrame:
    at = F.col(row) if row else F.monotonically_increasing_id()
    placed = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), at.alias("at"))
    return placed.withColumn("bits", F.concat(bits(F.col("key")), bits(F.col("at"))))


def _leaves(todo: DataFrame, known: int, depth: int, limit: int, final: bool) -> DataFrame:
    """(cell, shard, shard_bytes, shard_rows) of the cells of `depth` bits that have a prefix of over `known` bits that fits."""
    cells = todo.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    each = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(known), F.lit(depth))).alias("k")).withColumn("shard", F.expr("substring(cell, 1, k)"))
    sums = each.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fit = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    fits = sums.where(fit | (F.length("shard") == depth) if final else fit)
    return each.select("cell", "shard").join(fits, "shard").groupBy("cell").agg(F.min_by(F.struct("shard", "shard_bytes", "shard_rows"), F.length("shard")).alias("x")).select("cell", "x.*")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, row: str | None = None) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, oversized) for each row of docs; shard is the bucket's prefix of bits.

    row: a column of longs that tells rows of one key apart; the result has it too.
    """
    todo = materialize(_rows(docs, key, text, row), "shard-rows")
    total = todo.agg(F.sum("n_bytes")).first()[0] or 0
    known, done, used = 0, None, [todo]
    depth = min(MOST_FIRST_BITS, max(0, (total // limit).bit_length()) + SPARE_BITS)
    while True:
        final = depth >= KEY_BITS + PLACE_BITS
        cell = F.substring("bits", 1, depth)
        leaves = materialize(_leaves(todo, known, depth, limit, final), "shard-leaves")
        part = todo.withColumn("cell", cell).join(leaves, "cell").drop("cell")
        done = part if done is None else done.unionByName(part)
        rest = materialize(todo.withColumn("cell", cell).join(leaves.select("cell"), "cell", "left_anti").drop("cell"), "shard-rest")
        used += [leaves, rest]
        if final or rest.limit(1).count() == 0:
            break
        todo, known, depth = rest, depth + 1, min(depth + MORE_BITS, KEY_BITS + PLACE_BITS)
    out = materialize(done.select(F.col("key").alias(key), "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"), *([F.col("at").alias(row)] if row else [])), "shards")
    release(*used)
    return out


def directory(assigned: DataFrame) -> DataFrame:
    """A row for each shard: its prefix, local depth, rows, bytes, and the directory entries that point at it."""
    by = assigned.groupBy("shard", "depth").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    top = by.agg(F.max("depth").alias("global_depth"))
    return by.crossJoin(F.broadcast(top)).withColumn("entries", F.pow(F.lit(2), F.col("global_depth") - F.col("depth")).cast("bigint"))


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Parquet files under path/shard=<prefix>; each shard is within the limit, so that one task writes it.

    Rows are numbered in a work table, so that repeated rows and rows without a key are written once each.
    """
    held = materialize(docs.withColumn("_shard_row", F.monotonically_increasing_id()), "shard-docs")
    shards = assign(held, key, text, limit, "_shard_row")
    x = held.join(shards.select("_shard_row", F.concat(F.lit("b"), F.col("shard")).alias("shard")), "_shard_row").drop("_shard_row")
    x.repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
    release(held, shards)


def op7(docs: DataFrame) -> DataFrame:
    return assign(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "shard", F.col("depth").cast("bigint").alias("depth"), "shard_bytes", "oversized")


ORACLE = f"""
WITH hashed AS (
    SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT), {KEY_BITS}, '0') AS bits
    FROM documents),
sums AS (
    SELECT left(bits, k) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
    FROM hashed, (SELECT unnest(range(0, {KEY_BITS + 1})) AS k) GROUP BY ALL),
fits AS (SELECT shard, shard_bytes, len(shard) AS depth FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR n = 1)
SELECT doc_id, n_bytes, arg_min(shard, depth) AS shard, min(depth)::BIGINT AS depth, arg_min(shard_bytes, depth) AS shard_bytes, arg_min(shard_bytes, depth) > {SHARD_BYTES} AS oversized
FROM hashed JOIN fits ON shard = left(bits, depth) GROUP BY doc_id, n_bytes
"""
