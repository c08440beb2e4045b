"""The jobs as registered queries: each runs twice into a new folder in the shared one, and gives what stands there."""

from __future__ import annotations

import uuid

from docweave.plans.q_text import clean_sql
from docweave.plans.tables import shared_dir

from . import ingest_passages, usage_report


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/docweave-jobs/{name}-{uuid.uuid4().hex}"


def job1_ingest_passages(spark, sf_dir):
    at = new_folder(spark, "passages")
    # a glob, as a file stream takes no single file by its name
    for _ in range(2):
        found = ingest_passages.run(spark, f"{sf_dir}/documents*.parquet", f"{at}/passages", f"{at}/checkpoint")
    return found


def job2_usage_report(spark, sf_dir):
    at = new_folder(spark, "usage")
    for _ in range(2):
        found = usage_report.run(spark, f"{sf_dir}/events.parquet", f"{at}/report")
    return found


QUERIES = {"job1_ingest_passages": job1_ingest_passages, "job2_usage_report": job2_usage_report}

_C = ingest_passages.Config()
ORACLE = {
    "job1_ingest_passages": rf"""
WITH d AS (SELECT *, coalesce({clean_sql('text')}, '') AS c, sha256(coalesce(lang, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '')) AS content_hash FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT *, regexp_extract_all(c, '(?:\S+\s*){{1,{_C.block_words}}}') AS blocks FROM d),
p AS (SELECT *, unnest(range(1, greatest(len(blocks) - {_C.shared_blocks}, 1) + 1, {_C.passage_blocks - _C.shared_blocks})) AS start FROM b),
t AS (SELECT *, ((start - 1) / {_C.passage_blocks - _C.shared_blocks})::INT AS passage, regexp_replace(coalesce(array_to_string(blocks[start : start + {_C.passage_blocks - 1}], ''), ''), '\s+$', '') AS passage_text FROM p),
h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '_' || passage)) AS h FROM t)
SELECT doc_id, lower(lang) AS jurisdiction, source AS title, content_hash, passage, len(regexp_extract_all(passage_text, '\S+')) AS n_words, passage_text AS text,
    h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id, floor(doc_id / {_C.ids_per_part})::BIGINT AS part
FROM h
""",
    "job2_usage_report": f"""
SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(ms), 6) AS mean, round(min(ms), 6) AS least, round(max(ms), 6) AS most,
    count(*) FILTER (ms < 2000) AS fast, count(*) FILTER (ms >= 2000 AND ms < 5000) AS mid, count(*) FILTER (ms >= 5000) AS slow, ts::DATE AS day
FROM (SELECT *, value * {usage_report.Config().unit_ms} AS ms FROM events WHERE ts IS NOT NULL) GROUP BY event_type, ts::DATE
""",
}
