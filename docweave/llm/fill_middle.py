"""Fill-in-middle transformation, in Spark SQL functions only.

A text is cut into units, letter runs or single other characters, by regexp_extract_all. Two cuts and the form come from
groups of hexadecimal digits of a hash of the identifier, read by conv and substring. slice and array_join arrange prefix,
middle and suffix between sentinels; `restored` finds the sentinels in an arranged text and puts the text together again.
Every row is worked on where it lies: there is no shuffle, and nothing but the identifier decides, so that reruns agree.

Defined results: a null text is an empty one, and an empty text stays plain, as does one that holds a sentinel of its own;
a null identifier is hashed as no digits at all; repeated rows and equal identifiers give the same cuts for the same text,
and equal cuts an empty middle; the result is a struct column of a name to be chosen beside all columns of the table, or in the
place of one of that name, whatever they are called; an empty table gives an empty one. A text's units are in memory at
once, some 60 bytes each, so that a text of 10 MB needs about 200 MB of its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = "([A-Za-z]+|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = SENTINELS = "<P>", "<S>", "<M>"
#: Of a hundred texts that may be arranged, so many are left plain; of a hundred arranged ones so many have their suffix first.
PLAIN_PERCENT = 10
SPM_PERCENT = 20
SEED = 1


def _number(digest: Column, group: int) -> Column:
    """The group-th eight hexadecimal digits, from 0, as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("bigint")


def arrange(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "fim", seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs with the struct column `out`: n_units, form (plain, psm or spm), prefix, middle, suffix (null if plain), output."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != out)).alias("row")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # units and cuts are columns of their own, so that each is computed once
    x = docs.select(row, body.alias("body"), digest.alias("digest"))
    x = x.select("*", F.regexp_extract_all("body", F.lit(UNITS), F.lit(1)).alias("units"))
    x = x.select("*", F.size("units").cast("bigint").alias("n"))
    cuts = [_number(F.col("digest"), g) % (F.col("n") + 1) for g in (0, 1)]
    own = F.lit(False)
    for s in SENTINELS:
        own = own | F.contains("body", F.lit(s))
    plain = (F.col("n") == 0) | own | (_number(F.col("digest"), 2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_number(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    x = x.select("row", "body", "units", "n", F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"), form.alias("form"))
    arranged = F.col("form") != "plain"
    part = lambda start, length: F.when(arranged, F.array_join(F.slice("units", start, length), ""))
    x = x.select("row", "body", "n", "form", part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"))
    orders = {"psm": (PREFIX, "prefix", SUFFIX, "suffix", MIDDLE, "middle"), "spm": (SUFFIX, "suffix", PREFIX, "prefix", MIDDLE, "middle")}
    output = F.col("body")
    for name, parts in orders.items():
        output = F.when(F.col("form") == name, F.concat(*(F.lit(p) if p in SENTINELS else F.col(p) for p in parts))).otherwise(output)
    made = F.struct(F.col("n").alias("n_units"), "form", "prefix", "middle", "suffix", output.alias("output"))
    return x.select("row.*", made.alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text from which output was arranged: what stands between the sentinels, in its first order."""
    parts = F.split(output, "|".join(SENTINELS), -1)
    # before the first sentinel stands nothing, so that parts count from the second
    first, second, last = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(second, last, first)).otherwise(output)


def op11(docs: DataFrame) -> DataFrame:
    x = arrange(docs.select("doc_id", "text"))
    fim = x["fim"]
    return x.select(
        "doc_id",
        fim["n_units"].alias("n"),
        fim["form"].alias("form"),
        F.length(fim["prefix"]).cast("bigint").alias("prefix_chars"),
        F.length(fim["middle"]).cast("bigint").alias("middle_chars"),
        F.sha2(fim["output"], 256).alias("output_sha256"),
        F.sha2(restored(fim["output"], fim["form"]), 256).alias("restored_sha256"),
    )


#: DuckDB: the parts are cut by positions here, and the restored text is the text.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(d, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 : n], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
