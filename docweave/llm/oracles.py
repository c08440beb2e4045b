"""DuckDB SQL for operators that SQL can express on whole tables: they state the result, not the method."""

from __future__ import annotations

from .quality_ledger import BASE, BIT

_SPACE = r"[\x20\x09-\x0D]"
_ROWS = "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"list_filter(regexp_split_to_array({{}}, '{_SPACE}+'), lambda x: x <> '')"
_COUNT = "length(regexp_replace(t, '{}', '', 'g'))"

_FAILS = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "shouting": "n_letters >= 40 AND 2 * n_upper > n_letters",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 30 * n_words OR word_chars < 2 * n_words",
}
QUALITY = rf"""
WITH {_ROWS},
w AS (SELECT *, {_SPLIT.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY rid),
m AS (
    SELECT doc_id, len(w) AS n_words, {_COUNT.format(_SPACE)} AS word_chars, {_COUNT.format('[^#*$%&|<>]')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(l) AS n_lines, {_COUNT.format('[^A-Z]')} AS n_upper, {_COUNT.format('[^A-Za-z]')} AS n_letters
    FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, ({' + '.join(f'CASE WHEN {_FAILS[r]} THEN {bit} ELSE 0 END' for r, bit in BIT.items())})::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    failure_bits & {BASE} <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b
"""

_WORDS = rf"regexp_extract_all({_LOW.format('{}')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = rf"""
WITH {_ROWS},
w AS (SELECT rid, doc_id, {_WORDS.format('t')} AS w FROM d),
items AS (SELECT *, least(13, len(w)) AS m FROM (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
spots AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS k FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM items) WHERE len(w) >= m)),
hit AS (SELECT rid, item, m, i FROM spots JOIN win USING (m, k)),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY rid),
pos AS (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM hit),
runs AS (SELECT rid, count(*) AS n FROM (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS g FROM pos) GROUP BY rid, g),
sums AS (SELECT rid, sum(n) AS n_hit, max(n) AS longest FROM runs GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest_hit
FROM w LEFT JOIN found USING (rid) LEFT JOIN sums USING (rid)
"""

COMPONENTS = rf"""
WITH RECURSIVE {_ROWS},
w AS (SELECT rid, doc_id, {_SPLIT.format(_LOW.format('t'))} AS w FROM d),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b USING (k) WHERE a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT a, y FROM reach JOIN both_ways ON b = x),
least_id AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN w ON b = w.rid GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN n USING (rid) JOIN least_id USING (rid)
"""
