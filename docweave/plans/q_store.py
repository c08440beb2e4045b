"""Relations, splitters and streams on conversations, events, documents and authored values."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import chunk as ck
from ..operators import metrics as mt
from ..operators import rules as rl
from ..operators import store as st
from ..sources import corpus as cp
from ..streaming import answers as an
from ..streaming import cache as ca
from ..streaming import memo as me
from ..streaming import sinks as sk
from . import ingest as ig
from .tables import ASSISTANT_SQL, DOCUMENTS_SQL, USER_SQL, documents_as, literal, shared_dir, spread, spread_sql, sql_values, table, turns_as, values


def messages(spark, sf_dir):
    """turn is the order of time within a conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), F.col("turn").alias("timestamp"))


def conversations(spark, sf_dir):
    """Twice as many identifiers as there are conversations, so that empty ones are listed."""
    n = table(spark, sf_dir, "conversations").agg(F.max("conv_id").alias("n"))
    return n.select(F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * F.col("n"))).alias("id")).withColumn("updated_at", F.col("id") % 97)


def list_conversations(spark, sf_dir):
    return st.list_conversations(conversations(spark, sf_dir), messages(spark, sf_dir)).select("id", "updated_at", "message_count", "last_message_time")


def get_conversation(spark, sf_dir):
    return st.get_conversation(messages(spark, sf_dir), 7).select("id", "role", "content", "timestamp")


def latest_n(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return st.latest(e, 50, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type", "user_id")


def newest_first(spark, sf_dir):
    """Users of the events in the order of their first one, the newest first."""
    return st.newest_first(table(spark, sf_dir, "events"), "user_id", "event_id")


def recent_history(spark, sf_dir):
    """The last six messages of each conversation; every thirteenth message counts as an error."""
    m = messages(spark, sf_dir).withColumn("is_error", F.col("id") % 13 == 0)
    return st.recent_history(m, "conversation_id", "timestamp", "is_error").select("conversation_id", "id", "role")


def isolation_terms(spark, sf_dir):
    """Candidates of one jurisdiction whose source or section names a term of the other; here, none should be French."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", F.concat(F.lit("Section "), "lang").alias("section"))
    terms = F.array(F.lit("section fr"), F.lit("traité"))
    hit = F.exists(terms, lambda t: F.lower("section").contains(t) | F.lower("source").contains(t))
    return d.agg(F.count_if(hit).alias("leaks"), F.count("*").alias("n"))


def upsert_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("id"), F.col("text").alias("title"), F.when(F.col("turn") % 2 == 0, "national").otherwise("international").alias("jurisdiction"), F.col("turn").alias("at"), F.col("turn").alias("seq"))
    return st.upsert_conversations(e)


def upsert_latest(spark, sf_dir):
    """Documents, of which every fifth comes again with a new version."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    old, new = d.withColumn("version", F.lit(1)), d.where("doc_id % 5 = 0").select("doc_id", F.reverse("digest").alias("digest"), F.lit(2).alias("version"))
    return st.upsert(old, new, "doc_id", "version")


def delete_anti(spark, sf_dir):
    """Messages left after deleting every third conversation."""
    c = messages(spark, sf_dir)
    gone = c.where("conversation_id % 3 = 0").select("conversation_id")
    return st.without(c, gone, "conversation_id").groupBy("conversation_id").agg(F.count("*").alias("n"))


def semi_sessions(spark, sf_dir):
    mine = values(spark, [(i,) for i in (1, 3, 5, 8, 13, 21, 100000)], "conversation_id bigint")
    return st.only(messages(spark, sf_dir), mine, "conversation_id").select("conversation_id", "id", "role")


def turn_memory(spark, sf_dir):
    t = st.turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return t.select("conv_id", "turn", "query", st.summary(F.col("answer")).alias("summary"))


def audit(spark, sf_dir):
    return audit_events(table(spark, sf_dir, "events"))


def audit_events(e):
    none = lambda c, k: F.when(F.col("event_id") % k != 0, c)
    return e.select(
        F.col("event_id").alias("timestamp"), F.upper(F.lit("National")).alias("jurisdiction"), F.concat(F.lit("  q\n"), "props").alias("query"), none(F.col("event_type"), 7).alias("classification"),
        none(F.col("event_type"), 3).alias("provider_used"), F.col("value").alias("latency_ms"), (F.col("event_id") % 11 == 0).alias("abstained"), none(F.col("user_id").cast("string"), 5).alias("conversation_id"), none(F.lit("hi"), 2).alias("detected_lang"),
    )


def _log_folder(spark, name):
    return f"{shared_dir(spark)}/docweave-logs/{name}-{uuid.uuid4().hex}"


AUDIT_TYPES = "timestamp bigint, jurisdiction string, query string, classification string, provider_used string, latency_ms double, abstained boolean, conversation_id string, detected_lang string"
AUDIT_LINES = AUDIT_TYPES.replace("abstained boolean", "abstained int")


def _audit_log(at, export=True):
    return sk.Log(f"{at}/table", AUDIT_TYPES, "timestamp", f"{at}/export" if export else None, AUDIT_LINES, lambda rows: st.audit_rows(rows, "batch"))


def _appended(spark, sf_dir, name, rows, log, at):
    """Two runs of the stream over a table's files, the second of which finds nothing new."""
    for _ in range(2):
        source = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")
        sk.append(log, rows(source), f"{at}/checkpoint")


def audit_append(spark, sf_dir):
    """The audit log's export, as its CSV files are read back, of a log that is written by a stream."""
    at = _log_folder(spark, "audit")
    log = _audit_log(at)
    _appended(spark, sf_dir, "events", audit_events, log, at)
    return sk.export(spark, log).select(*st.AUDIT_HEADER)


def audit_back_fill(spark, sf_dir):
    """The same of a log whose export was switched on when the stream had ended, filled twice."""
    at = _log_folder(spark, "audit-later")
    _appended(spark, sf_dir, "events", audit_events, _audit_log(at, export=False), at)
    log = _audit_log(at)
    for _ in range(2):
        sk.back_fill(spark, log)
    return sk.export(spark, log).select(*st.AUDIT_HEADER)


def feedback_append(spark, sf_dir):
    """Ratings of the assistant's turns, written by a stream: snippets of 500 in the table, lines of 300 in the export."""
    at = _log_folder(spark, "feedback")
    kept = "id bigint, rating string, comment string, snippet string, export_snippet string, citations string"
    lines = "id bigint, rating string, comment string, snippet string, citations string"
    project = lambda rows: rows.select("id", "rating", "comment", F.col("export_snippet").alias("snippet"), "citations", "batch")
    log = sk.Log(f"{at}/table", kept, "id", f"{at}/export", lines, project)
    turns = lambda c: c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text")
    _appended(spark, sf_dir, "conversations", lambda c: st.feedback_rows(ratings(turns(c))), log, at)
    t, e = sk.table(spark, log), sk.export(spark, log)
    return t.drop("batch", "export_snippet").join(e.select("id", F.col("snippet").alias("export_snippet"), F.col("comment").alias("export_comment")), "id")


def audit_projection(spark, sf_dir):
    a = st.audit_rows(audit(spark, sf_dir).withColumn("latency_ms", F.floor(F.col("latency_ms") * 8) / 8))
    return a.withColumn("latency_ms", F.round("latency_ms", 6))


def audit_stats(spark, sf_dir):
    """Dashboard figures over the last 500 events."""
    last = st.latest(table(spark, sf_dir, "events"), 500, F.desc("event_id"))
    types = F.array_join(F.array_sort(F.collect_set(F.coalesce("event_type", F.lit("none")))), ",")
    return last.agg(F.round(F.avg("value"), 6).alias("avg_latency"), F.count_if(F.col("event_id") % 11 == 0).alias("abstained"), types.alias("providers"), F.count("*").alias("n"))


def latency_tiers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(rl.latency_tier(F.col("value") * 100).alias("tier")).agg(F.count("*").alias("n"))


def latency_summary(spark, sf_dir):
    return mt.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


def argmin_sweep(spark, sf_dir):
    return mt.argmin(table(spark, sf_dir, "events"), "event_type", "value")


def feedback_flatten(spark, sf_dir):
    """A rating for each assistant turn, with or without comment, answer and citations."""
    return st.feedback_rows(ratings(turns_as(spark, sf_dir, "assistant")))


def ratings(t):
    kind = F.col("row") % 3
    cites = "array<struct<source:string,section:string>>"
    some = F.array(F.struct(F.lit("Act"), F.concat(F.lit("Section "), "row")), F.struct(F.lit(""), F.lit("Rule 2")), F.struct(F.lit("Only source"), F.lit(None))).cast(cites)
    return t.select(
        F.col("row").alias("id"), F.when(kind == 0, " UP ").when(kind == 1, "down").otherwise("up").alias("rating"), F.when(kind == 0, "  good ").when(kind == 1, "   ").alias("comment"),
        F.when(F.col("row") % 5 > 0, F.concat("text", F.lit("\n"), "text")).alias("answer_snippet"), F.when(kind == 0, some).when(kind == 1, F.array().cast(cites)).alias("citations"),
    )


def conditional_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("national"), F.count_if(F.col("lang") != "en").alias("international"))


def locate_files(spark, sf_dir):
    """Conversations as files, asked for by their names, in capitals, without separators, by longer names and by wrong ones."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = F.concat(F.lit("Conv-"), "conv_id", F.lit(".pdf"))
    i = F.col("conv_id") % 5
    asked = F.when(i == 0, name).when(i == 1, F.upper(name)).when(i == 2, F.concat(F.lit("conv "), "conv_id", F.lit(".pdf"))).when(i == 3, F.concat(F.lit("conv_"), "conv_id", F.lit("(a copy).pdf"))).otherwise(F.concat(F.lit("the conv "), "conv_id", F.lit("pdf of all")))
    return cp.locate(ids.select(asked.alias("filename")), ids.select(name.alias("name"), F.concat(F.lit("/corpus/"), name).alias("path")))


def corpus_pages(spark, sf_dir):
    """The documents of each jurisdiction, in pages of a hundred, as a client asks for them."""
    d = table(spark, sf_dir, "documents").withColumn("jurisdiction", F.when(F.col("lang") == "en", "national").otherwise("international"))
    return cp.paged(d, "jurisdiction", "doc_id", 100).select("jurisdiction", "doc_id", "source", "n_chars", "page", "place")


def corpus_grouped(spark, sf_dir):
    """Documents by jurisdiction and source: counts and ranges rather than lists, which a hot source would outgrow."""
    d = table(spark, sf_dir, "documents")
    by = F.when(F.col("lang") == "en", "national").otherwise("international")
    return d.groupBy(by.alias("jurisdiction"), "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_chars").alias("chars"))


def corpus_ingest(spark, sf_dir):
    """The state of a corpus after three runs, the last of which finds nothing due, and whether its points follow it.

    At first every seventh document is a longer draft, every eleventh is not there yet, and every thirteenth has a copy that
    is gone later. Texts too short for a chunk have none.
    """
    at = f"{shared_dir(spark)}/docweave-ingest/{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents")
    copies = d.where("doc_id % 13 = 2").withColumn("doc_id", -F.col("doc_id"))
    m = d.unionByName(copies).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("jurisdiction"), F.lit("section").alias("chunk_strategy"), *(F.lit("").alias(c) for c in ("citation_prefix", "authority", "category", "priority", "year")))
    text = lambda x: x.select(F.col("doc_id").cast("string").alias("id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    draft = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.concat("text", F.lit(" and what was left out later. ")), F.lit(3))).otherwise(F.col("text"))
    ig.run(spark, at, m, text(d.where("doc_id % 11 <> 1").unionByName(copies).withColumn("text", draft)), "2024-01-01", complete=True)
    for day in ("2024-01-02", "2024-01-03"):
        ig.run(spark, at, m, text(d), day, complete=True)
    x = ig.checked(spark, at)
    return x.select("id", "title", "jurisdiction", "content_hash", "run", "whole")


def incremental_ingest(spark, sf_dir):
    """Every seventh document changed since the recorded state: those are to be read again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    recorded = d.select("id", F.when(F.col("id") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return st.changed(d, recorded).select("id", "content_hash")


def page_range_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("int").alias("page"))
    return cp.in_ranges(p, cp.drug_act_ranges(spark)).select("page_id", "part")


def text_layer(spark, sf_dir):
    """Pages taken as those of files of twenty; a page's text is its markup without tags."""
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 20).alias("document"), (F.col("page_id") % 20).alias("page"), F.length(F.trim(F.regexp_replace("html", "(?s)<[^>]*>", ""))).alias("chars"))
    return cp.text_layer(p, "document", "page", "chars")


ANSWERS = [(1, 1, "Act A", "Section 3"), (1, 2, "unknown", "x"), (1, 3, "act", "3"), (2, 1, "Act B", ""), (3, 1, "none", "none")]
CHUNKS = [(1, 1, "Act A of 1970", "Section 3(p)", "text one", 0.9), (1, 2, "Act A", "Section 4", "text two", 0.8), (2, 1, "Other", "9", "text three", 0.7), (2, 2, "Act B", "Rule 1", "text four", 0.6)]
NO_CHUNK = (3, 0, None, None, None, None)


def citation_join(spark, sf_dir):
    """Documents as questions, each with the citations of one of the answers and its chunks, which end in the document."""
    d = documents_as(spark, sf_dir)
    a = spread(d, ANSWERS, "query_id int, cit int, source string, section string", "query_id", numbers=[r[0] - 1 for r in ANSWERS])
    c = spread(d, [*CHUNKS, NO_CHUNK], "query_id int, rank int, title string, section string, text string, score double", "query_id", ("text",), numbers=[r[0] - 1 for r in [*CHUNKS, NO_CHUNK]])
    return st.join_citations(a, c.where("rank > 0"))


def citation_metrics(spark, sf_dir):
    c = citation_join(spark, sf_dir)
    return c.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("title").isNotNull()).alias("linked"), F.count_if("verified").alias("verified"), F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"))


def duplicate_chunks(spark, sf_dir):
    return mt.duplicates(table(spark, sf_dir, "documents"), "source", "text")


ACT = (
    "ARRANGEMENT OF SECTIONS\n" + "1. Short title\n2. Definitions\n" * 12 + "\nCHAPTER I\nPRELIMINARY\n1. Short title and extent of this Act in the whole territory. It applies from the day that is notified for it.\n"
    '2. Definitions of this Act.—\n(a) "invention" means a new product or process that involves a step and can be used;\n(b) "patent" means what is granted under this Act for an invention of whatever kind;\n(c) "prescribed" means prescribed by rules made under this Act, and not otherwise at all;\n'
    "3. What are not inventions. " + "A long clause of words that goes on; and then some more. " * 110 + "\n4. Closing words."
)
CLAUSES = ACT[ACT.index("2. Definitions of") : ACT.index("3. What are")]
TREATY = "Convention on Biological Diversity\n" + "Preamble text of the parties. " * 4 + "\nArticle\n\nObjectives of all\nThe objectives of this treaty are many.\nARTICLE 2\nUse of Terms\nTerms mean what they say.\nArticle 3. Principle of states\nBody of three."
LEGAL = [(1, "section", ACT), (2, "article", TREATY), (3, "rule", "158B. Labels and packing of all such drugs as are made here under these words of rule.\n159. Next rule of the part with enough words that it is kept in the list."), (4, "section", None), (5, "section", "short"), (6, "heading", "No markers here at all. " * 200)]


def legal(spark):
    return values(spark, LEGAL, "id int, strategy string, text string")


def _digest(x):
    return x.select(*(c for c in x.columns if c not in ("text", "strategy")), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def section_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).cast("int").alias("id"), F.lit("section").alias("strategy"), "text")
    both = legal(spark).unionByName(d)
    return _digest(ck.split_documents(both, strategy=F.col("strategy")))


def article_split(spark, sf_dir):
    """Documents that follow the articles of a treaty, as the end of its last one."""
    d = spread(documents_as(spark, sf_dir), [(0, TREATY)], "id int, text string", "id", ("text",))
    return _digest(ck.split_documents(d, split=lambda t, s: ck.articles(t or "")))


def subclause_split(spark, sf_dir):
    """Documents that follow the clauses of an act's definitions, as the end of the last one."""
    d = spread(documents_as(spark, sf_dir), [(0, CLAUSES)], "id int, text string", "id", ("text",))
    return _digest(ck.split_documents(d, split=lambda t, s: ck.subclauses("Section 2 — Definitions", t or "") or []))


def recursive_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(ck.split_documents(d, split=lambda t, s: [("", p) for p in ck.by_size(t or "")]))


DELTAS = [
    ("a", 0, '{"ans'), ("a", 1, 'wer": "Sec'), ("a", 2, "tion 3(p)\\n"), ("a", 3, 'says \\"no'), ("a", 4, '\\".'), ("a", 5, '", "cit'), ("a", 6, 'ations": []'), ("a", 7, "}"),
    ("b", 0, "Just "), ("b", 1, "some "), ("b", 2, "plain "), ("b", 3, "text."), ("c", 0, "<think>hidden"), ("c", 1, ' still</think>{"answer":'), ("c", 2, ' "shown"}'), ("d", 0, "long plain words " * 4), ("d", 1, "more of the same " * 4), ("d", 2, "end"),
]


def deltas(turns, size=40):
    """Assistant turns as a model streams them: JSON in pieces of so many characters, for every other turn after thoughts."""
    said = F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.lit("a")).alias("citations")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("said") - 1) / size).cast("int")), lambda i: F.substring("said", i * size + 1, size))
    thoughts = F.when(F.col("row") % 2 == 0, F.array(F.lit("<think>hidden"), F.lit(' "answer": "not this"</think>'))).otherwise(F.array().cast("array<string>"))
    x = turns.select(F.col("row").cast("string").alias("request_id"), "row", said.alias("said"))
    return x.select("request_id", F.posexplode(F.concat(thoughts, parts)).alias("seq", "delta")).withColumn("seq", F.col("seq").cast("bigint"))


def answer_extract(spark, sf_dir):
    return an.extract(deltas(turns_as(spark, sf_dir, "assistant")))


def streamed(spark, sf_dir, name, of_table):
    """What a streaming query over all files of a table writes until it has read them, read back; of_table: stream to stream.

    The files are a glob, as a file stream takes no single file by its name.
    """
    at = f"{shared_dir(spark)}/docweave-streams/{name}-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")
    found = of_table(source)
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out")


def answer_stream(spark, sf_dir):
    """Answers put together while their deltas arrive."""
    turns = lambda c: c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text")
    x = streamed(spark, sf_dir, "conversations", lambda c: an.extract_stream(deltas(turns(c))))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"])
    return x.groupBy("request_id").agg(F.array_join(parts, "").alias("answer"))


def turn_memory_stream(spark, sf_dir):
    """What is remembered of each conversation when its last turn has arrived."""
    turns = lambda c: c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    x = streamed(spark, sf_dir, "conversations", lambda c: an.recent_turns_stream(turns(c))).distinct()
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return x.withColumn("n", n).where("n <= 3").drop("n")


def cache_replay(spark, sf_dir):
    """Event types and users as requests to caches of ten entries, one per type."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("user_id").cast("string").alias("key"))
    return ca.replay(e, "event_type", "event_id", "key", 10)


def retrieval_memo(spark, sf_dir):
    """Users' event types as questions to the memo of 512 entries."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    e = table(spark, sf_dir, "events").select("event_id", me.memo_key(user, kind, F.lit(None).cast("string")).alias("key"))
    x = me.replay(e, "event_id", "key", f"{shared_dir(spark)}/docweave-memo/{uuid.uuid4().hex}", width=5000)
    return x.select("event_id", F.split("key", "\x1f")[0].cast("bigint").alias("user_id"), "epoch", "hit")


def sse_decode(spark, sf_dir):
    """Each user turn as the body of an event stream, with a comment, and an event at its end that is not finished."""
    t = turns_as(spark, sf_dir)
    first = F.to_json(F.struct(F.lit("retrieval").alias("stage"), F.length("text").alias("chars"), F.col("text").alias("query")))
    body = F.concat(F.lit("data: "), first, F.lit('\n\n: comment\n\ndata:{"stage":"complete"}\n\ndata: {"stage":"compl'))
    return an.decode_events(t.select(F.col("row").alias("request_id"), F.when(F.col("row") % 4 > 0, body).otherwise("").alias("body")))


def stages(events):
    """Events as stages of their users' requests; by what a stage is told, some come late and some are unknown."""
    e = events.selectExpr("user_id as request_id", "event_id as seq", f"cast((event_id * 7 + user_id) % {len(fixed.STAGES) + 2} as int) as n")
    known = F.array(*map(F.lit, fixed.STAGES))
    return e.select("request_id", "seq", F.coalesce(F.get(known, F.col("n")), F.when(F.col("n") == len(fixed.STAGES), "error").otherwise("unknown")).alias("stage"))


def stage_order(spark, sf_dir):
    return an.out_of_order(stages(table(spark, sf_dir, "events")), fixed.STAGES)


def stage_order_stream(spark, sf_dir):
    """The same, checked while the events arrive."""
    return streamed(spark, sf_dir, "events", lambda e: an.out_of_order_stream(stages(e), fixed.STAGES))


_NAMES = """list_conversations get_conversation latest_n newest_first recent_history isolation_terms upsert_conversations upsert_latest delete_anti semi_sessions turn_memory audit_projection audit_append audit_back_fill feedback_append audit_stats latency_tiers latency_summary
argmin_sweep feedback_flatten conditional_counts locate_files corpus_pages corpus_grouped corpus_ingest incremental_ingest page_range_join text_layer citation_join citation_metrics duplicate_chunks section_split article_split
subclause_split recursive_split answer_extract answer_stream turn_memory_stream cache_replay retrieval_memo sse_decode stage_order stage_order_stream""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_M = "(SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, role, text AS content, turn AS timestamp FROM conversations)"
_BOTH = "(contains(lower({0}), lower({1})) OR contains(lower({1}), lower({0})))"
_CJ = f"""SELECT query_id, cit, source, section, rank, title, text, score, coalesce(hit, false) AS verified FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, cit ORDER BY coalesce(hit, false) DESC, rank NULLS LAST) AS n FROM (
        SELECT c.query_id, cit, source, c.section, rank, title, text, score::DOUBLE AS score, {_BOTH.format('source', 'title')} AND {_BOTH.format('c.section', 'k.section')} AS hit
        FROM {spread_sql(DOCUMENTS_SQL, ANSWERS, 'c', 'query_id, cit, source, section', 'query_id', numbers=[r[0] - 1 for r in ANSWERS])}
        LEFT JOIN (SELECT * FROM {spread_sql(DOCUMENTS_SQL, [*CHUNKS, NO_CHUNK], 'k0', 'query_id, rank, title, section, text, score', 'query_id', ('text',), numbers=[r[0] - 1 for r in [*CHUNKS, NO_CHUNK]])} WHERE rank > 0) AS k USING (query_id))) WHERE n = 1"""


_SUMMARY = "CASE WHEN len(l) > 0 THEN l[1] ELSE trim(answer) END"
ORACLE = {
    "list_conversations": f"""WITH c AS (SELECT unnest(range(0, 2 * (SELECT max(conv_id) FROM conversations) + 1)) AS id), m AS (SELECT conversation_id, count(*) AS n, max(timestamp) AS t FROM {_M} GROUP BY 1)
        SELECT id, id % 97 AS updated_at, coalesce(n, 0) AS message_count, t AS last_message_time FROM c LEFT JOIN m ON id = conversation_id ORDER BY updated_at DESC, id LIMIT 50""",
    "get_conversation": f"SELECT id, role, content, timestamp FROM {_M} WHERE conversation_id = 7",
    "latest_n": "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "newest_first": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1",
    "recent_history": f"SELECT conversation_id, id, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC) AS n FROM {_M} WHERE id % 13 <> 0) WHERE n <= 6",
    "isolation_terms": "SELECT 0::BIGINT AS leaks, count(*) AS n FROM documents WHERE lang = 'en'",
    "upsert_conversations": "SELECT conv_id AS id, arg_min(text, turn) AS title, arg_min(CASE WHEN turn % 2 = 0 THEN 'national' ELSE 'international' END, turn) AS jurisdiction, min(turn) AS created_at, max(turn) AS updated_at FROM conversations GROUP BY conv_id",
    "cache_replay": """WITH e AS (SELECT event_type, event_id, user_id::VARCHAR AS key, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS before FROM events),
        between AS (SELECT a.event_id, count(DISTINCT b.key) AS others FROM e a JOIN e b ON b.event_type = a.event_type AND b.event_id > a.before AND b.event_id < a.event_id GROUP BY 1)
        SELECT event_type, event_id, key, before IS NOT NULL AND coalesce(others, 0) < 10 AS hit FROM e LEFT JOIN between USING (event_id)""",
    "upsert_latest": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN reverse(md5(text)) ELSE md5(text) END AS digest, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM documents",
    "delete_anti": "SELECT conv_id AS conversation_id, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id",
    "semi_sessions": f"SELECT conversation_id, id, role FROM {_M} WHERE conversation_id IN (1, 3, 5, 8, 13, 21, 100000)",
    "turn_memory": f"""WITH x AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS query FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        t AS (SELECT conv_id, turn, query, text AS answer, list_filter(list_transform(string_split(trim(text), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM x WHERE role = 'assistant' AND before = 'user' AND query <> '')
        SELECT conv_id, turn, query, CASE WHEN length({_SUMMARY}) > 280 THEN left({_SUMMARY}, 280) || '...' ELSE {_SUMMARY} END AS summary FROM t WHERE n <= 3""",
    "audit_projection": """SELECT event_id AS timestamp, 'national' AS jurisdiction, trim(replace('  q' || chr(10) || props, chr(10), ' ')) AS query, CASE WHEN event_id % 7 <> 0 THEN event_type ELSE '' END AS classification, CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'none' END AS provider_used,
        round(round_even(floor(value * 8) / 8, 2), 6) AS latency_ms, (event_id % 11 = 0)::INT AS abstained, CASE WHEN event_id % 5 <> 0 THEN user_id::VARCHAR ELSE '' END AS conversation_id, CASE WHEN event_id % 2 <> 0 THEN 'hi' ELSE 'en' END AS detected_lang FROM events""",
    "audit_stats": "SELECT round(avg(value), 6) AS avg_latency, count(*) FILTER (event_id % 11 = 0) AS abstained, string_agg(DISTINCT coalesce(event_type, 'none'), ',' ORDER BY coalesce(event_type, 'none')) AS providers, count(*) AS n FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500)",
    "latency_tiers": "SELECT CASE WHEN value * 100 < 2000 THEN 'latency-fast' WHEN value * 100 < 5000 THEN 'latency-mid' ELSE 'latency-slow' END AS tier, count(*) AS n FROM events GROUP BY 1",
    "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1",
    "argmin_sweep": "SELECT event_type, mean FROM (SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1) ORDER BY mean, event_type LIMIT 1",
    "feedback_flatten": f"""SELECT id, CASE kind WHEN 1 THEN 'down' ELSE 'up' END AS rating, CASE kind WHEN 0 THEN 'good' END AS comment, left(coalesce(snippet, ''), 500) AS snippet, left(replace(coalesce(snippet, ''), chr(10), ' '), 300) AS export_snippet,
        CASE kind WHEN 0 THEN 'Act (Section ' || id || '); Rule 2; Only source' ELSE '' END AS citations FROM (SELECT row AS id, row % 3 AS kind, CASE WHEN row % 5 > 0 THEN text || chr(10) || text END AS snippet FROM ({ASSISTANT_SQL}))""",
    "conditional_counts": "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS national, count(*) FILTER (lang <> 'en') AS international FROM documents",
    "locate_files": r"""WITH n AS (SELECT DISTINCT conv_id, 'Conv-' || conv_id || '.pdf' AS name FROM conversations),
        w AS (SELECT CASE conv_id % 5 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN 'conv ' || conv_id || '.pdf' WHEN 3 THEN 'conv_' || conv_id || '(a copy).pdf' ELSE 'the conv ' || conv_id || 'pdf of all' END AS filename FROM n),
        p AS (SELECT filename, regexp_replace(lower(filename), '[\s_.,()-]', '', 'g') AS a FROM w), q AS (SELECT name, regexp_replace(lower(name), '[\s_.,()-]', '', 'g') AS b FROM n),
        j AS (SELECT *, CASE WHEN filename = name THEN 1 WHEN lower(filename) = lower(name) THEN 2 WHEN contains(a, b) OR contains(b, a) THEN 3 END AS r FROM p, q)
        SELECT filename, '/corpus/' || arg_min(name, (r, name)) FILTER (r IS NOT NULL) AS path FROM j GROUP BY 1""",
    "corpus_pages": "SELECT jurisdiction, doc_id, source, n_chars, (n - 1) // 100 AS page, (n - 1) % 100 AS place FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY doc_id) AS n FROM (SELECT *, CASE WHEN lang = 'en' THEN 'national' ELSE 'international' END AS jurisdiction FROM documents))",
    "corpus_grouped": "SELECT CASE WHEN lang = 'en' THEN 'national' ELSE 'international' END AS jurisdiction, source, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2",
    "incremental_ingest": "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 = 0",
    "page_range_join": f"SELECT page_id, part FROM pages JOIN {sql_values(fixed.DRUG_ACT_PAGES, 'r', 'start, stop, part')} ON page_id >= start AND page_id < stop",
    "text_layer": "SELECT document, avg(chars) >= 50 OR sum(chars) >= 100 AS has_text FROM (SELECT page_id // 20 AS document, page_id % 20 AS page, length(trim(regexp_replace(html, '(?s)<[^>]*>', '', 'g'))) AS chars FROM pages) WHERE page < 5 GROUP BY 1",
    "citation_join": _CJ,
    "citation_metrics": f"SELECT query_id, count(*) AS n, count(title) AS linked, count(*) FILTER (verified) AS verified, string_agg(DISTINCT section, '|' ORDER BY section) AS sections FROM ({_CJ}) GROUP BY 1",
    "duplicate_chunks": "SELECT source, count(*) AS n, count(*) - count(DISTINCT coalesce(text, '')) AS duplicates FROM documents GROUP BY 1",
    "answer_extract": f"SELECT row::VARCHAR AS request_id, text AS answer FROM ({ASSISTANT_SQL})",
    "sse_decode": f"""SELECT row AS request_id, seq, CASE seq WHEN 0 THEN 'retrieval' ELSE 'complete' END AS stage, CASE seq WHEN 0 THEN '{{"stage":"retrieval","chars":' || length(text) || ',"query":' || to_json(text) || '}}' ELSE '{{"stage":"complete"}}' END AS payload
        FROM ({USER_SQL}), (SELECT unnest([0, 1]) AS seq) WHERE row % 4 > 0""",
    "stage_order": f"""SELECT request_id, seq, stage FROM (SELECT *, lag(place) OVER (PARTITION BY request_id ORDER BY seq) AS before FROM (SELECT *, coalesce(list_position({literal(fixed.STAGES)}, stage), 0) AS place FROM (SELECT user_id AS request_id, event_id AS seq, coalesce({literal(fixed.STAGES)}[(event_id * 7 + user_id) % {len(fixed.STAGES) + 2} + 1], CASE WHEN (event_id * 7 + user_id) % {len(fixed.STAGES) + 2} = {len(fixed.STAGES)} THEN 'error' ELSE 'unknown' END) AS stage FROM events) WHERE stage <> 'error'))
        WHERE place = 0 OR place < before""",
}
_AUDIT_LINES = ORACLE["audit_projection"].replace("floor(value * 8) / 8", "value")
ORACLE["audit_append"] = ORACLE["audit_back_fill"] = _AUDIT_LINES
ORACLE["feedback_append"] = f"SELECT id, rating, comment, snippet, citations, left(replace(snippet, chr(10), ' '), 300) AS export_snippet, comment AS export_comment FROM ({ORACLE['feedback_flatten']})"
ORACLE["corpus_ingest"] = """SELECT doc_id::VARCHAR AS id, source AS title, lower(lang) AS jurisdiction, sha256(coalesce(text, '')) AS content_hash,
    CASE WHEN doc_id % 7 = 0 AND text IS NOT NULL OR doc_id % 11 = 1 THEN 2 ELSE 1 END AS run, true AS whole FROM documents WHERE doc_id IS NOT NULL"""
ORACLE["retrieval_memo"] = """WITH RECURSIVE log AS MATERIALIZED (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events),
    epochs AS (SELECT min(event_id) AS epoch FROM events UNION ALL
        SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY epoch ORDER BY event_id) AS nth FROM epochs JOIN log ON event_id >= epoch AND coalesce(before < epoch, true)) WHERE nth = 513)
    SELECT event_id, user_id, epoch, coalesce(before >= epoch, false) AS hit FROM log ASOF JOIN epochs ON event_id >= epoch"""
ORACLE["answer_stream"], ORACLE["stage_order_stream"] = ORACLE["answer_extract"], ORACLE["stage_order"]
ORACLE["turn_memory_stream"] = "SELECT conv_id, turn, text AS query FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 3"
