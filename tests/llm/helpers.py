"""Small document tables with the awkward rows that every operator has to stand."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t\r\x0b\x0c "),
    (4, "one"),
    (5, "Ünïcödé 漢字 words with odd spaces 😀 end"),
    (6, "a b c d e f g h i j k l m n"),
    (6, "a b c d e f g h i j k l m n"),
    (None, "no id but some words here, ten or more of them, really"),
    (7, "tie tie tie tie tie tie tie tie tie tie tie tie"),
]


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(sorted(r.items(), key=str)))
