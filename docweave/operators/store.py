"""Relations of the service: ingest state, points, conversations, audit and feedback; upserts, deletes, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(manifest: DataFrame, state: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """Rows of a manifest that are new or whose content differs from the recorded state."""
    return manifest.join(state.select(key, digest), [key, digest], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: that of the highest version, new ones before old of the same."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_documents(old: DataFrame, new: DataFrame, document: str) -> DataFrame:
    """All rows of the documents in `new` replaced, so that a document that shrank leaves nothing behind."""
    return old.join(new.select(document).distinct(), document, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those deleted; for a cascade, apply it to the child relation too."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def upsert_conversations(events: DataFrame) -> DataFrame:
    """events(id, title, jurisdiction, at, seq) to conversations: the first event's title and jurisdiction stay, later
    ones only move updated_at."""
    return events.groupBy("id").agg(F.min_by("title", "seq").alias("title"), F.min_by("jurisdiction", "seq").alias("jurisdiction"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def list_conversations(conversations: DataFrame, messages: DataFrame, n: int = 50) -> DataFrame:
    """The latest n conversations with their number of messages and the time of the last; empty ones too.

    Messages are counted by conversation before the join, and only the n that are listed are sorted.
    """
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.max("timestamp").alias("last_message_time"))
    x = conversations.join(counts, conversations["id"] == counts["conversation_id"], "left")
    x = x.select(conversations["*"], F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"), "last_message_time")
    return latest(x, n, F.desc("updated_at"), F.asc("id"))


def get_conversation(messages: DataFrame, conversation_id: object) -> DataFrame:
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("timestamp", "id")


def latest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def audit_rows(events: DataFrame, *more: str) -> DataFrame:
    """Audit rows with their defaults: one line, latency to 2 places, blanks for what is missing. `more` are columns to keep."""
    fill = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return events.select(
        "timestamp",
        F.lower("jurisdiction").alias("jurisdiction"),
        F.trim(F.regexp_replace("query", "\n", " ")).alias("query"),
        fill("classification", "").alias("classification"),
        fill("provider_used", "none").alias("provider_used"),
        F.bround("latency_ms", 2).alias("latency_ms"),
        F.col("abstained").cast("int").alias("abstained"),
        fill("conversation_id", "").alias("conversation_id"),
        fill("detected_lang", "en").alias("detected_lang"),
        *more,
    )


AUDIT_HEADER = ["timestamp", "jurisdiction", "query", "classification", "provider_used", "latency_ms", "abstained", "conversation_id", "detected_lang"]


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table; the committer makes them visible at once."""
    rows.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A full CSV export with a header in every part."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def flat_citations(citations: Column) -> Column:
    """array<struct<source, section>> as `source (section)`, or whichever is not blank, joined by `; `."""
    def one(c: Column) -> Column:
        a, b = F.trim(F.coalesce(c["source"], F.lit(""))), F.trim(F.coalesce(c["section"], F.lit("")))
        return F.when((a != "") & (b != ""), F.concat(a, F.lit(" ("), b, F.lit(")"))).when(a != "", a).otherwise(b)

    return F.array_join(F.transform(citations, one), "; ")


def feedback_rows(events: DataFrame) -> DataFrame:
    """Feedback for the table (snippet of 500) and the export (one line of 300)."""
    snippet = F.coalesce("answer_snippet", F.lit(""))
    return events.select(
        "id",
        F.lower(F.trim("rating")).alias("rating"),
        F.nullif(F.trim("comment"), F.lit("")).alias("comment"),
        F.substring(snippet, 1, 500).alias("snippet"),
        F.substring(F.regexp_replace(snippet, "\n", " "), 1, 300).alias("export_snippet"),
        flat_citations(F.coalesce("citations", F.array())).alias("citations"),
    )


def turns(messages: DataFrame, conversation: str, order: str, role: str, content: str, last: int | None = 3) -> DataFrame:
    """(conversation, turn, query, answer): each assistant message with the user message right before it, other roles
    aside; blank questions count as none. `last` keeps the last few turns of a conversation."""
    x = messages.where(F.col(role).isin("user", "assistant"))
    w = Window.partitionBy(conversation).orderBy(order)
    x = x.withColumn("_role", F.lag(role).over(w)).withColumn("query", F.lag(content).over(w))
    x = x.where((F.col(role) == "assistant") & (F.col("_role") == "user") & (F.col("query") != ""))
    x = x.select(conversation, F.col(order).alias("turn"), "query", F.col(content).alias("answer"))
    if last is None:
        return x
    n = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc("turn")))
    return x.withColumn("_n", n).where(F.col("_n") <= last).drop("_n")


def summary(answer: Column, limit: int = 280) -> Column:
    """An answer's first line that is not blank, cut at limit."""
    lines = F.filter(F.transform(F.split(F.trim(answer), "\n"), F.trim), lambda y: y != "")
    first = F.when(F.size(lines) > 0, lines[0]).otherwise(F.trim(answer))
    return F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("..."))).otherwise(first)


def join_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations(query_id, cit, source, section) with the first chunk, by rank, whose title and section contain or are
    contained in theirs; without one, the query's first chunk. A blank is contained in everything.

    `verified` says whether a chunk matched.
    """
    c, k = citations.alias("c"), chunks.select("query_id", "rank", "title", F.col("section").alias("chunk_section"), "text", "score").alias("k")
    low = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    both = lambda a, b: low(a).contains(low(b)) | low(b).contains(low(a))
    x = c.join(k, "query_id", "left").withColumn("hit", F.col("k.rank").isNotNull() & both("c.source", "k.title") & both("c.section", "k.chunk_section"))
    n = F.row_number().over(Window.partitionBy("query_id", "cit").orderBy(F.desc(F.coalesce("hit", F.lit(False))), F.asc_nulls_last("rank")))
    x = x.withColumn("_n", n).where("_n = 1")
    return x.select("query_id", "cit", "source", "section", "rank", "title", "text", "score", F.coalesce("hit", F.lit(False)).alias("verified"))


def newest_first(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Keys in the order in which they first came, the newest first, each once."""
    return events.groupBy(key).agg(F.min(seq).alias(seq)).orderBy(F.desc(seq), key)


def recent_history(messages: DataFrame, conversation: str, order: str, is_error: str, last: int = 6) -> DataFrame:
    """The last few messages of each conversation that are no errors."""
    n = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order)))
    return messages.where(~F.coalesce(is_error, F.lit(False))).withColumn("_n", n).where(F.col("_n") <= last).drop("_n")
