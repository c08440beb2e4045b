"""BM25 statistics: term and document frequencies, lengths. `postings` keeps them.

Everything is per partition of the corpus (`jurisdiction`); scores of different partitions are not comparable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


@dataclass(frozen=True)
class Index:
    tf: DataFrame  # jurisdiction, id, term, tf, length
    df: DataFrame  # jurisdiction, term, df
    stats: DataFrame  # jurisdiction, n, avg_length


def tokens(docs: DataFrame, id: str, jurisdiction: str, text: str, tokenizer=words) -> DataFrame:
    """(jurisdiction, id, tokens, length); null text has no tokens."""
    t = tokenizer(F.coalesce(F.col(text), F.lit("")))
    x = docs.select(F.lower(jurisdiction).alias("jurisdiction"), F.col(id).alias("id"), t.alias("tokens"))
    return x.withColumn("length", F.size("tokens").cast("bigint"))


def term_frequencies(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Counts of each document's terms; with `terms`, only of those.

    A document is one row, so that its terms are counted within it and nothing is shuffled: in the sorted array each
    run of equal tokens begins where the one before ends.
    """
    x = tokens.select("jurisdiction", "id", "length", F.sort_array("tokens").alias("s"))
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    x = x.withColumn("at", starts).withColumn("to", F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("s"))))
    runs = F.zip_with("at", "to", lambda a, b: F.struct(F.get("s", a).alias("term"), (b - a).cast("bigint").alias("tf")))
    x = x.select("jurisdiction", "id", "length", F.explode(runs).alias("r")).select("jurisdiction", "id", F.col("r")["term"].alias("term"), F.col("r")["tf"].alias("tf"), "length")
    x = x.where("term is not null")  # of a document without tokens; a filter on its length would tokenise twice
    return x if terms is None else x.join(terms, "term", "left_semi").select("jurisdiction", "id", "term", "tf", "length")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("jurisdiction", "term").agg(F.count("*").alias("df"))


def statistics(tokens: DataFrame) -> DataFrame:
    """Documents and their mean length in each partition; documents without tokens count."""
    return tokens.groupBy("jurisdiction").agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))


def build(docs: DataFrame, id: str, jurisdiction: str, text: str, terms: DataFrame | None = None, tokenizer=words, place: str | None = None) -> Index:
    """With terms, the frequencies are of those only. With a place as well, a new folder, texts are read and cut into tokens
    once: the lengths and the tokens among the terms are written there. Terms are few then, as they go to all tasks."""
    t = tokens(docs, id, jurisdiction, text, tokenizer)
    if terms is not None and place is not None:
        asked = terms.agg(F.collect_set("term").alias("asked"))
        own = F.filter("tokens", lambda x: F.array_contains("asked", x))
        t.crossJoin(F.broadcast(asked)).select("jurisdiction", "id", own.alias("tokens"), "length").write.parquet(place)
        t = docs.sparkSession.read.schema(t.schema).parquet(place)
    tf = term_frequencies(t, terms)
    return Index(tf, document_frequencies(tf), statistics(t))


def idf(n: Column, df: Column, least: float = 0.001) -> Column:
    return F.greatest(F.log(1 + (n - df + 0.5) / (df + 0.5)), F.lit(least))
