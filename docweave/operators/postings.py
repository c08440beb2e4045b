"""A stored inverted index for BM25: searched without reading or scoring most of it, and kept up to date by segments.

Layout. Postings are Parquet, partitioned by segment, jurisdiction and a bucket of the term's hash, so that a search opens
the files of its own terms only; within these they are sorted by term, so that of a file only row groups of those are read.
A row holds the postings of one term in one block of documents. Blocks are the same for all terms: documents of like
length, and of those some by their hash, BLOCK to 4 * BLOCK at most. The blocks of a frequent term lie in many rows, which
are dealt by (jurisdiction, bucket, some of the blocks) to as many tasks and files as the texts' size asks for. Postings are
shuffled once, a row for the terms of a document in a bucket, and are grouped where they arrive, block by block.

Search. A row also has the highest frequency and the shortest length in its block, which bound what the term can add to
any document there, whatever the statistics are by then. The sum over a question's terms bounds the scores of a block. The
SEEDS most promising blocks are scored first; with the k-th score among them, blocks whose bound is below are left out.
The result is that of scoring everything, which is what is done for up to FEW_ROWS rows of postings, as bounds cost more there,
and for many questions, whose bounds leave out little: then each asked term's postings go once to the task of their block,
and meet the questions there, so that neither postings nor scores are shuffled for each question.

Without an index, `scan` finds the same hits in one pass over the texts: only the asked terms of each document are kept, which
costs a question asked once less than an index of all terms does.

Change. `append` adds a segment: postings of the new documents, which documents of earlier segments are gone, and how
document frequencies and statistics differ, for which the old versions are needed, but nothing of the documents that stay.
Statistics are written last, and a segment without them is not there. A search adds the differences up. `compact` writes
what is live as one segment in another place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from . import index as ix
from .rank import K1, B, top

#: To be changed with the columns below, so that a place that is named by it has no index of other columns.
FORMAT = "postings-2"
BUCKETS = 16
BLOCK = 1024
SEEDS = 4
#: Rows (question, term) up to which terms are sent to the scans as literals; beyond it they are joined.
MOST_TERMS = 1000
#: Rows of postings, each of a term in a block, up to which scoring all of them takes less than finding what to leave out.
FEW_ROWS = 1000
#: Rows (question, jurisdiction, term) of weights up to which they go to all tasks; beyond it they are joined by a shuffle.
MOST_WEIGHTS = 200_000
#: Characters of text whose postings a task writes, about, and tokens of which it counts the terms at once.
TASK_CHARS, SLICE = 8_000_000, 500_000
KEY = ["query_id", "jurisdiction"]
_POSTINGS = "term string, block bigint, n bigint, total_tf bigint, max_tf bigint, min_length bigint, docs array<struct<id:{id},tf:bigint,length:bigint>>, segment int, jurisdiction string, bucket int"
_DF = "term string, df bigint, segment int, jurisdiction string, bucket int"
_STATS = "jurisdiction string, n bigint, total_length bigint, buckets int, id_type string, segment int"


@dataclass(frozen=True)
class Postings:
    postings: DataFrame  # term, block, n, total_tf, max_tf, min_length, docs(id, tf, length), segment, jurisdiction, bucket
    df: DataFrame  # term, df, segment, jurisdiction, bucket
    stats: DataFrame  # jurisdiction, n, total_length, segment
    gone: DataFrame  # id, segment: not in any earlier segment from then on
    segments: tuple[int, ...]
    buckets: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, segment: int, *by: str) -> None:
    """Overwrites what a run that failed may have left of this segment, and no other one."""
    rows.withColumn("segment", F.lit(segment)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", *by).parquet(path)


def _counted(buckets: int):
    """Rows (jurisdiction, id, length, block, split, tokens, at) to rows of a document's terms of one bucket with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(ends):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
                x, lo = batch.slice(lo, hi - lo), hi
                tokens = x.column("tokens")
                code = tokens.flatten().dictionary_encode()
                if not len(code):
                    continue
                doc = np.repeat(np.arange(len(x)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                key = (doc * buckets + x.column("at").flatten().to_numpy()) * len(code.dictionary) + code.indices.to_numpy()
                key, tf = np.unique(key, return_counts=True)
                group, term = np.divmod(key, len(code.dictionary))
                starts = np.flatnonzero(np.diff(group, prepend=-1))
                of, bucket = np.divmod(group[starts], buckets)
                offsets = pa.array(np.append(starts, len(group)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (code.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int32)))]
                kept = ["jurisdiction", "id", "length", "block", "split"]
                yield pa.RecordBatch.from_arrays([*(x.column(c).take(pa.array(of)) for c in kept), pa.array(bucket.astype(np.int32)), *lists], [*kept, "bucket", "terms", "tfs"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (jurisdiction, bucket, block, id, length, terms, tfs), those of a block in a bucket one after the other, to a row
    for each term in a block. In memory are a batch and a block."""
    by, held = ["jurisdiction", "bucket", "block"], None

    def rows(x: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        code = x.column("terms").flatten().dictionary_encode()
        row = np.repeat(np.arange(len(x)), pc.list_value_length(x.column("terms")).to_numpy(zero_copy_only=False))
        key = group[row] * len(code.dictionary) + code.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        tf, length = x.column("tfs").flatten().to_numpy()[order].astype(np.int64), x.column("length").to_numpy()[row]
        docs = pa.StructArray.from_arrays([x.column("id").take(pa.array(row)), pa.array(tf), pa.array(length)], ["id", "tf", "length"])
        ends = np.append(starts, len(key))
        figures = [np.diff(ends), np.add.reduceat(tf, starts), np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts)]
        keys = [*(x.column(c).take(pa.array(row[starts])) for c in by), code.dictionary.take(pa.array(key[starts] % len(code.dictionary)))]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, figures), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), docs)], [*by, "term", "n", "total_tf", "max_tf", "min_length", "docs"])

    def whole(x: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        codes = [x.column("jurisdiction").dictionary_encode(null_encoding="encode").indices, x.column("bucket"), x.column("block")]
        new = np.append(True, np.any([np.diff(c.to_numpy()) != 0 for c in codes], axis=0))
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        stops = np.append(starts[1:], len(x))
        if not last:  # the last block may go on in the next batch
            held, stops = x.slice(starts[-1]), stops[:-1]
        size = np.append(0, np.cumsum(pc.list_value_length(x.column("terms")).to_numpy(zero_copy_only=False)))
        lo = 0
        for at, stop in enumerate(stops):
            if at + 1 == len(stops) or size[stops[at + 1]] - size[lo] > SLICE:
                yield rows(x.slice(lo, stop - lo), group[lo:stop] - group[lo])
                lo = stop

    for batch in batches:
        if len(batch):
            yield from whole(batch if held is None else pa.concat_batches([held, batch]), False)
    if held is not None:
        yield from whole(held, True)


def _segment(path: str, segment: int, buckets: int, docs: DataFrame, counts: DataFrame, old: DataFrame | None, counted: bool = False) -> None:
    """Writes a segment: tokens of the new documents, counts(jurisdiction, n, chars) of them, tokens of the old versions.
    counted: docs are terms with their frequencies, of which the driver gets none; of counts it gets a row of each jurisdiction."""
    spark = docs.sparkSession
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    n_docs, chars = counts.agg(F.sum("n"), F.sum("chars")).first()
    n_docs = n_docs or 0
    alike = F.floor(2 * F.log2(F.col("length") + 1)).cast("bigint")
    block = F.shiftleft(alike, 40) + F.pmod(F.xxhash64("id"), F.lit(max(1, n_docs // (4 * BLOCK))))
    splits = max(1, n_docs // (64 * BLOCK), (chars or 0) // (16 * TASK_CHARS))
    id_type = docs.schema["id"].dataType.simpleString()
    order = ["jurisdiction", "bucket", "term", "block"]
    x = docs.withColumn("block", block).withColumn("split", F.pmod(F.xxhash64("block"), F.lit(splits)).cast("int"))
    if counted:
        x = x.withColumns({"bucket": _bucket(F.col("term"), buckets), "terms": F.array("term"), "tfs": F.array(F.col("tf").cast("int"))})
    else:
        x = x.withColumn("at", F.transform("tokens", lambda t: _bucket(t, buckets))).select("jurisdiction", "id", "length", "block", "split", "tokens", "at")
        x = x.mapInArrow(_counted(buckets), f"jurisdiction string, id {id_type}, length bigint, block bigint, split int, bucket int, terms array<string>, tfs array<int>")
    x = x.repartition(max(splits, (chars or 0) // TASK_CHARS + 1), "jurisdiction", "bucket", "split").sortWithinPartitions("jurisdiction", "bucket", "block")
    x = x.select("jurisdiction", "bucket", "block", "id", "length", "terms", "tfs")
    rows = x.mapInArrow(_grouped, f"jurisdiction string, bucket int, block bigint, term string, n bigint, total_tf bigint, max_tf bigint, min_length bigint, docs array<struct<id:{id_type},tf:bigint,length:bigint>>")
    _write(rows.sortWithinPartitions(*order), f"{path}/postings", segment, "jurisdiction", "bucket")
    stored = spark.read.schema(_POSTINGS.format(id=id_type)).parquet(f"{path}/postings").where(F.col("segment") == segment)

    df = stored.groupBy("jurisdiction", "term").agg(F.sum("n").alias("df"))
    lengths = stored.groupBy("jurisdiction").agg(F.sum("total_tf").alias("total_length"))
    stats = counts.join(lengths, "jurisdiction", "left").select("jurisdiction", "n", F.coalesce("total_length", F.lit(0)).alias("total_length"))
    if old is not None:
        less = old.select("jurisdiction", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("jurisdiction", "term").agg(-F.count("*"))
        df = df.union(less).groupBy("jurisdiction", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        stats = stats.union(old.groupBy("jurisdiction").agg(-F.count("*"), -F.sum("length")))
        stats = stats.groupBy("jurisdiction").agg(F.sum("n").alias("n"), F.sum("total_length").alias("total_length"))
        _write(old.select("id").distinct(), f"{path}/gone", segment)
    df = df.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("jurisdiction", "bucket").sortWithinPartitions("jurisdiction", "bucket", "term")
    _write(df, f"{path}/df", segment, "jurisdiction", "bucket")
    # a row more, so that a segment without documents is known to be there
    stats = stats.unionByName(spark.createDataFrame([(None, 0, 0)], "jurisdiction string, n bigint, total_length bigint"))
    _write(stats.withColumns({"buckets": F.lit(buckets), "id_type": F.lit(id_type)}).coalesce(1), f"{path}/stats", segment)


def _counts(docs: DataFrame, jurisdiction: str, text: str) -> DataFrame:
    return docs.groupBy(F.lower(jurisdiction).alias("jurisdiction")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).cast("bigint").alias("chars"))


def create(path: str, docs: DataFrame, id: str, jurisdiction: str, text: str, tokenizer=words, buckets: int = BUCKETS) -> Postings:
    """The index of docs, written to path. Texts are read for their size, and once for their terms."""
    _segment(path, 0, buckets, ix.tokens(docs, id, jurisdiction, text, tokenizer), _counts(docs, jurisdiction, text), None)
    return load(docs.sparkSession, path)


def append(path: str, new: DataFrame, old: DataFrame, id: str, jurisdiction: str, text: str, tokenizer=words) -> Postings:
    """Adds a segment: new are documents to be added, old the versions as indexed of those that are replaced or go."""
    spark = new.sparkSession
    now = load(spark, path)
    tokens = ix.tokens(new, id, jurisdiction, text, tokenizer)
    _segment(path, max(now.segments) + 1, now.buckets, tokens, _counts(new, jurisdiction, text), ix.tokens(old, id, jurisdiction, text, tokenizer))
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Postings:
    """The index as of now. The driver gets a row of each segment and jurisdiction."""
    stats = spark.read.schema(_STATS).parquet(f"{path}/stats")
    found = stats.groupBy("segment").agg(F.max("buckets").alias("buckets"), F.max("id_type").alias("id_type")).collect()
    segments, id_type = tuple(sorted(r["segment"] for r in found)), found[0]["id_type"]
    whole = lambda table, schema: spark.read.schema(schema).parquet(f"{path}/{table}").where(F.col("segment").isin(list(segments)))
    gone = f"id {id_type}, segment int"
    gone = whole("gone", gone) if len(segments) > 1 else spark.createDataFrame([], gone)
    return Postings(whole("postings", _POSTINGS.format(id=id_type)), whole("df", _DF), stats, gone, segments, found[0]["buckets"])


def _live(rows: DataFrame, index: Postings) -> DataFrame:
    """rows(segment, id, ...) without those of documents that a later segment has replaced or taken away."""
    if len(index.segments) == 1:
        return rows
    last = index.gone.groupBy("id").agg(F.max("segment").alias("_last"))
    return rows.join(last, "id", "left").where("_last is null or segment >= _last").drop("_last")


def _part(tf: Column, length: Column, k1: float, b: float) -> Column:
    norm = F.when(F.col("avg_length") > 0, length / F.col("avg_length")).otherwise(0.0)
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))


def asked(index: Postings, terms: DataFrame) -> DataFrame:
    """The rows of the questions' terms, each with the term's weight. terms: (query_id, q_jurisdiction, term)."""
    return _asked(index, terms)[0]


def _asked(index: Postings, terms: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """`asked`, and the postings that it reads if their terms are known; None if they are too many."""
    postings, df = index.postings, index.df
    rows = terms.select("term", "q_jurisdiction", _bucket(F.col("term"), index.buckets).alias("bucket")).limit(MOST_TERMS + 1).collect()
    few = len(rows) <= MOST_TERMS
    if few:
        own = F.col("bucket").isin(sorted({r["bucket"] for r in rows})) & F.col("term").isin(sorted({r["term"] for r in rows}))
        within = {r["q_jurisdiction"] for r in rows}
        if None not in within:
            own &= F.col("jurisdiction").isin(sorted(within))
        postings, df = postings.where(own), df.where(own)
    weights = _weights(df, index.stats, terms)
    return postings.join(F.broadcast(weights) if few else weights, ["jurisdiction", "term"]), postings if few else None


def _weights(df: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    frequencies = df.groupBy("jurisdiction", "term").agg(F.sum("df").alias("df"))
    stats = stats.groupBy("jurisdiction").agg(F.sum("n").alias("n"), F.sum("total_length").alias("total_length")).where("n > 0")
    weights = frequencies.join(terms, "term").where("q_jurisdiction is null or q_jurisdiction = jurisdiction").join(F.broadcast(stats), "jurisdiction")
    return weights.select(*KEY, "term", ix.idf(F.col("n"), F.col("df")).alias("idf"), (F.col("total_length") / F.col("n")).alias("avg_length"))


def _by_block(index: Postings, terms: DataFrame, k1: float, b: float) -> DataFrame | None:
    """(query_id, jurisdiction, id, score) of all documents that share a term with a question; None if there are more weights
    than may go to all tasks. A document's postings are in one task, so that its scores are added up there."""
    n_docs = index.stats.agg(F.sum("n")).first()[0] or 0
    n_jurisdictions = index.stats.where("n > 0").select("jurisdiction").distinct().count()
    n_weights = terms.select(F.sum(F.when(F.col("q_jurisdiction").isNull(), n_jurisdictions).otherwise(1))).first()[0] or 0
    if n_weights > MOST_WEIGHTS:
        return None
    weights = _weights(index.df.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi"), index.stats, terms)
    met = index.postings.join(F.broadcast(weights.select("jurisdiction", "term").distinct()), ["jurisdiction", "term"], "left_semi")
    x = met.select("jurisdiction", "segment", "block", "term", "docs").repartition(max(1, n_docs // (4 * BLOCK)), "jurisdiction", "segment", "block")
    x = x.join(F.broadcast(weights), ["jurisdiction", "term"]).select(*KEY, "segment", "block", "idf", "avg_length", F.explode("docs").alias("d"))
    x = x.select(*KEY, "segment", "block", F.col("d")["id"].alias("id"), _part(F.col("d")["tf"], F.col("d")["length"], k1, b).alias("part"))
    scored = x.groupBy(*KEY, "segment", "block", "id").agg(F.round(F.sum("part"), 9).alias("score")).where("score > 0")
    return scored.drop("block")


def bounds(heads: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, jurisdiction, segment, block, bound): what no document of a block can score more than."""
    return heads.groupBy(*KEY, "segment", "block").agg(F.sum(_part(F.col("max_tf"), F.col("min_length"), k1, b)).alias("bound"))


def _scored(index: Postings, heads: DataFrame, blocks: DataFrame | None, k1: float, b: float) -> DataFrame:
    if blocks is not None:
        heads = heads.join(blocks, [*KEY, "segment", "block"], "left_semi")
    x = heads.select(*KEY, "segment", "idf", "avg_length", F.explode("docs").alias("d"))
    x = x.select(*KEY, "segment", F.col("d")["id"].alias("id"), _part(F.col("d")["tf"], F.col("d")["length"], k1, b).alias("part"))
    return _live(x.groupBy(*KEY, "segment", "id").agg(F.round(F.sum("part"), 9).alias("score")), index).where("score > 0")


def surviving(index: Postings, heads: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The blocks that may hold one of the k best: with a bound not below the k-th score of the seeds."""
    every = bounds(heads, k1, b)
    w = Window.partitionBy(*KEY).orderBy(F.desc("bound"), "segment", "block")
    seeds = every.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SEEDS)
    least = top(_scored(index, heads, seeds, k1, b), k, "score", "rank", *KEY).where(F.col("rank") == k).select(*KEY, F.col("score").alias("least"))
    # sums of parts differ in their last digits with their order
    return every.join(least, KEY, "left").where("least is null or bound >= least - 1e-6")


def search(index: Postings, terms: DataFrame, k: int = 20, k1: float = K1, b: float = B, prune: bool | None = None) -> DataFrame:
    """(query_id, jurisdiction, id, score, rank), as `rank.bm25` has it. Without prune all blocks are scored; None: by FEW_ROWS, and all, by block, for many questions."""
    heads, read = _asked(index, terms)
    if prune is None and read is None and (every := _by_block(index, terms, k1, b)) is not None:
        # the k best of each task go on; of documents that a later segment has replaced any number may be among them
        return top(_live(every, index).select(*KEY, "id", "score"), k, "score", "rank", *KEY)
    if prune is None:
        prune = read is None or read.select("term").limit(FEW_ROWS + 1).count() > FEW_ROWS
    blocks = surviving(index, heads, k, k1, b) if prune else None
    return top(_scored(index, heads, blocks, k1, b).select(*KEY, "id", "score"), k, "score", "rank", *KEY)


def _picked(asked):
    """Rows (jurisdiction, id, length, tokens) with, in the tokens' place, which of the asked terms these are and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
            code = pc.index_in(batch.column("tokens").flatten(), value_set=terms)
            doc = np.repeat(np.arange(len(batch)), sizes)[code.is_valid().to_numpy(zero_copy_only=False)]
            key, tf = np.unique(doc * len(terms) + code.drop_null().to_numpy(), return_counts=True)
            of, code = np.divmod(key, max(1, len(terms)))
            offsets = pa.array(np.searchsorted(of, np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (code, tf)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("jurisdiction", "id", "length")), *lists], ["jurisdiction", "id", "length", "codes", "tfs"])

    return run


def scan(docs: DataFrame, id: str, jurisdiction: str, text: str, terms: DataFrame, place: str, k: int = 20, tokenizer=words, k1: float = K1, b: float = B) -> DataFrame | None:
    """`search` of docs that have no index; None if there are more terms or weights than may go to all tasks.

    Texts are read and cut once. Of each document its length and the asked terms in it are written to place, a new folder;
    statistics are taken from there. These rows are shuffled once, and scored where they arrive. Jurisdictions that no
    question is for are not read. The driver gets the terms.
    """
    spark = docs.sparkSession
    asked = [r["term"] for r in terms.select("term").distinct().limit(MOST_WEIGHTS + 1).collect()]
    within = {r["q_jurisdiction"] for r in terms.select("q_jurisdiction").distinct().limit(MOST_TERMS + 1).collect()}
    if len(asked) > MOST_WEIGHTS:
        return None
    if None not in within and len(within) <= MOST_TERMS:
        docs = docs.where(F.lower(jurisdiction).isin(sorted(within)))
    x = ix.tokens(docs, id, jurisdiction, text, tokenizer)
    if len(asked) <= MOST_TERMS:  # before tokens go to Python
        x = x.withColumn("tokens", F.filter("tokens", lambda t: t.isin(asked)))
    types = f"jurisdiction string, id {x.schema['id'].dataType.simpleString()}, length bigint, codes array<int>, tfs array<int>"
    held = spark.sparkContext.broadcast(pa.array(asked, pa.string()))
    x.select("jurisdiction", "id", "length", "tokens").mapInArrow(_picked(held), types).write.parquet(place)
    x = spark.read.schema(types).parquet(place)

    stats = x.groupBy("jurisdiction").agg(F.count("*").alias("n"), F.sum("length").alias("total_length"))
    sizes = {r["jurisdiction"]: r["n"] for r in stats.collect()}
    n_weights = terms.select(F.sum(F.when(F.col("q_jurisdiction").isNull(), len(sizes)).otherwise(1))).first()[0] or 0
    if n_weights > MOST_WEIGHTS:
        return None
    code = spark.createDataFrame(list(enumerate(asked)), "code int, term string")
    df = x.select("jurisdiction", F.explode("codes").alias("code")).groupBy("jurisdiction", "code").agg(F.count("*").alias("df"))
    weights = _weights(df.join(F.broadcast(code), "code"), stats, terms).join(F.broadcast(code), "term").drop("term")
    x = x.where(F.size("codes") > 0).repartition(max(1, sum(sizes.values()) // (4 * BLOCK)), "jurisdiction", "id")
    x = x.select("jurisdiction", "id", "length", F.explode(F.arrays_zip("codes", "tfs")).alias("t")).select("jurisdiction", "id", "length", F.col("t")["codes"].alias("code"), F.col("t")["tfs"].alias("tf"))
    x = x.join(F.broadcast(weights), ["jurisdiction", "code"]).select(*KEY, "id", _part(F.col("tf"), F.col("length"), k1, b).alias("part"))
    scored = x.groupBy(*KEY, "id").agg(F.round(F.sum("part"), 9).alias("score")).where("score > 0")
    return top(scored, k, "score", "rank", *KEY)


def compact(index: Postings, path: str) -> Postings:
    """What is live, as an index of one segment at path, which has to be another place."""
    x = index.postings.select("segment", "jurisdiction", "term", F.explode("docs").alias("d")).select("segment", "jurisdiction", "term", "d.*")
    # six characters a token
    counts = index.stats.groupBy("jurisdiction").agg(F.sum("n").alias("n"), (6 * F.sum("total_length")).alias("chars")).where("n > 0")
    _segment(path, 0, index.buckets, _live(x, index), counts, None, counted=True)
    return load(index.postings.sparkSession, path)


def stored(spark: SparkSession, path: str) -> Postings | None:
    """The index at path, or None if there is none."""
    try:
        return load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
