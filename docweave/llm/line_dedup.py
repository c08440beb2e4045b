"""Line deduplication by site-relative frequency, in DataFrame operations only.

For each host, the pages that hold a line are divided by the host's pages. Lines on more than RATIO of them, and on at
least MIN_PAGES pages, are boilerplate of that host and are dropped from its texts.

A host can have at most (lines of an average page) / RATIO boilerplate lines, so that they fit one array per host; the
arrays are written and read back, and broadcast only if they are counted and few; else texts are joined by host and salt.

Defined results: lines are told apart after trimming spaces, tabs and carriage returns, by a 64-bit hash within their
host; blank lines are never dropped; a null text has no lines and stays null; an empty one stays empty; rows with a
null host form a host of their own; repeated rows count as pages of their own; an empty table gives an empty one; other
columns are left as they are (`_lines` names are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATIO = 0.1
MIN_PAGES = 3
#: Hosts and boilerplate lines, a name or a long each, that may be broadcast; beyond, a join salted SALTS times.
BROADCAST_MARKS = 200_000
SALTS = 32


def _mark(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(" \t\r")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x, F.lit(" \t\r")) != "")


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, mark, n_pages, host_pages) of the lines over the limits. One pass with map-side counts."""
    x = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    marks = x.select("host", F.explode(F.array_distinct(F.transform(_filled(_lines(F.col("text"))), _mark))).alias("mark"))
    counts = marks.groupBy("host", "mark").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    pages = x.groupBy("host").agg(F.count("*").alias("host_pages"))
    both = counts.alias("c").join(pages.alias("p"), F.col("c.host").eqNullSafe(F.col("p.host")))
    return both.where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages")).select("c.host", "mark", "n_pages", "host_pages")


def drop_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str = "_lines_dropped") -> DataFrame:
    """docs with the text freed of its host's boilerplate and a column that counts the lines dropped."""
    marks = boilerplate(docs, text, host, ratio, min_pages).groupBy("host").agg(F.collect_set("mark").alias("_lines_bad"))
    bad = materialize(marks, "boilerplate").withColumnRenamed("host", "_lines_host")
    held = bad.agg(F.count("*") + F.coalesce(F.sum(F.size("_lines_bad")), F.lit(0))).first()[0]
    if held <= BROADCAST_MARKS:
        x = docs.join(F.broadcast(bad), docs[host].eqNullSafe(bad["_lines_host"]), "left").drop("_lines_host")
    else:
        # the texts of a host that has very many go to SALTS tasks
        salted = docs.withColumn("_lines_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        bad = bad.withColumn("_lines_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        x = salted.join(bad, salted[host].eqNullSafe(bad["_lines_host"]) & (salted["_lines_salt"] == bad["_lines_of"]), "left").drop("_lines_host", "_lines_of", "_lines_salt")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda y: ~F.array_contains(F.col("_lines_bad"), _mark(y)) | (F.trim(y, F.lit(" \t\r")) == ""))
    x = x.withColumn("_lines_kept", F.when(F.col("_lines_bad").isNotNull(), kept))
    n = F.when(F.col("_lines_kept").isNull(), 0).otherwise(F.size(lines) - F.size("_lines_kept")).cast("bigint")
    x = x.withColumn(dropped, n)
    return x.withColumn(text, F.when(F.col(dropped) > 0, F.array_join("_lines_kept", "\n")).otherwise(F.col(text))).drop("_lines_kept", "_lines_bad")


def op5(docs: DataFrame) -> DataFrame:
    x = drop_lines(docs.select("doc_id", "text", "source"))
    return x.select("doc_id", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("bigint").alias("n_lines_left"), F.col("_lines_dropped").alias("n_dropped"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, source, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS marks, string_split(text, chr(10)) AS lines
    FROM documents),
each AS (SELECT source, unnest(list_distinct(list_filter(marks, lambda x: x <> ''))) AS mark FROM lines),
pages AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
bad AS (
    SELECT e.source, mark FROM each e JOIN pages p ON e.source IS NOT DISTINCT FROM p.source
    GROUP BY e.source, mark, host_pages HAVING count(*) >= 3 AND count(*) > 0.1 * host_pages),
by_host AS (SELECT source, list(mark) AS bad FROM bad GROUP BY source),
cut AS (
    SELECT doc_id, text, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13))) OR trim(x, ' ' || chr(9) || chr(13)) = '') END AS kept
    FROM lines l LEFT JOIN by_host b ON l.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(greatest(len(kept), CASE WHEN text IS NULL THEN 0 ELSE 1 END), 0)::BIGINT AS n_lines_left, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
    strlen(array_to_string(kept, chr(10)))::BIGINT AS n_bytes, md5(array_to_string(kept, chr(10))) AS text_md5
FROM cut
"""
