"""URL filtering with association rules.

Spark's FP-growth mines the token combinations of labelled pages' URLs; combinations that go with bad pages often
enough (support) and reliably enough (confidence) become blocking rules. Each rule is filed under its rarest token, an
inverted index that is joined with the tokens of the URLs; only then is the whole combination tested. Given host and
path rules come first and are final.

Combinations are mined below their rarest token. Tokens that occur in exactly the same of its labelled URLs are one item
there, and tokens that all of its URLs have are none, so that a long path that many labelled URLs share can't blow up
the number of combinations: what is left out has the same URLs as a shorter combination. A rule with such an item fits
URLs that show any of its tokens.

Defined results: a null URL, or one without "://", has an empty host and path, no tokens and the verdict allow; equal
URLs get equal verdicts; without usable labels there are no mined rules and everything else is allowed; of several rules that fit a URL `mined` names the one
with the highest confidence, then the one whose name sorts last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BAD = "label=bad"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Mining:
    """min_support: share of labelled URLs that show the combination and are bad; min_confidence: of those that show
    it, the share that is bad; min_lift: that share over the share of bad URLs at large; min_count: so many bad URLs
    have to show it, as a share of few labels is no evidence. The larger of min_support and min_count bounds the search."""

    min_support: float = 0.005
    min_confidence: float = 0.6
    min_lift: float = 1.5
    min_count: int = 10


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the scheme, host labels, path words and query keys. Digits become one #, so that ids agree."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[0-9]+", "#")
    some = lambda c, kind: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.translate(plain(x), "\n", " ")))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    keys = F.transform(F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    found = F.array_distinct(F.concat(some(F.array(scheme), "s:"), some(F.split(host, r"\."), "h:"), some(F.split(path, r"[/._-]"), "p:"), some(keys, "q:")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def _same_rows(of: str) -> list[Column]:
    """Aggregates over rows of (row, bad): how many, how many bad, and a signature of which they are."""
    return [F.count("*").alias(f"n{of}"), F.count_if("bad").alias("n_bad"), F.sum(F.col("row").cast("decimal(38,0)")).alias("sum"), F.bit_xor("row").alias("xor")]


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """labelled(items array<string>, bad boolean) -> rules(rule_id, items, confidence, support, keys, needs).

    items: one token of each set of equals; needs: those sets; keys: the set of the rarest one.

    A rule whose items contain another's, with the same URLs, is not listed: it blocks no URL that the other one doesn't.
    """
    spark = labelled.sparkSession
    rows = materialize(labelled.where(F.size("items") > 0).select(F.xxhash64(F.monotonically_increasing_id()).alias("row"), "items", "bad"), "url-labels")
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    floor = max(how.min_count, math.ceil(how.min_support * n), 1)
    empty = "rule_id bigint, items array<string>, confidence double, support double, keys array<string>, needs array<array<string>>"
    if n_bad < floor:
        release(rows)
        return spark.createDataFrame([], empty)
    each = rows.select("row", "bad", F.explode("items").alias("item"))
    alias = each.groupBy("item").agg(*_same_rows("")).where(F.col("n_bad") >= floor).groupBy("n", "sum", "xor").agg(F.min("item").alias("item"), F.array_sort(F.collect_set("item")).alias("twins"))
    alias = materialize(alias.select("item", "n", "twins"), "url-items")
    kept = each.join(alias.select("item", "n"), "item")
    kept = materialize(kept.groupBy("row", "bad").agg(F.array_sort(F.collect_set(F.struct("n", "item"))).alias("items")), "url-kept")

    # (row, bad, t, n, u): each token with every more frequent one of its row
    below = kept.select("row", "bad", F.posexplode("items").alias("at", "t"), "items").select("row", "bad", F.col("t")["item"].alias("t"), F.col("t")["n"].alias("n"), F.explode(F.expr("slice(items, at + 2, size(items))")["item"]).alias("u"))
    classes = below.groupBy("t", "n", "u").agg(*_same_rows("_both")).where((F.col("n_bad") >= floor) & (F.col("n_both") < F.col("n")))
    classes = classes.groupBy("t", "n_both", "sum", "xor").agg(F.min("u").alias("u"), F.collect_set("u").alias("us"))
    classes = materialize(classes.select("t", "u", "us"), "url-classes")
    baskets = below.join(classes.select("t", "u"), ["t", "u"]).groupBy("row", "t").agg(F.collect_set(F.struct("t", "u")).alias("below"))
    roots = kept.select("row", "bad", F.explode(F.col("items")["item"]).alias("t"))
    item = lambda t, u: F.concat(t, F.lit("\n"), u)  # noqa: E731  no token has a line end
    baskets = roots.join(baskets, ["row", "t"], "left").select(F.concat(F.array(item(F.col("t"), F.lit(""))), F.coalesce(F.transform("below", lambda x: item(x["t"], x["u"])), F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = materialize(baskets, "url-baskets")

    m = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / m, minConfidence=how.min_confidence).fit(baskets)
    good = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("confidence") * n >= how.min_lift * n_bad)).withColumn("x", F.col("antecedent"))
    good = good.where((F.size("x") == 1) | ~F.exists("x", lambda i: i.endswith("\n")))  # a token below its root implies it
    parts = good.select(F.xxhash64(F.array_sort("x")).alias("rule_id"), "confidence", (F.round(F.col("support") * m) / n).alias("support"), F.split(F.col("x")[0], "\n")[0].alias("t"), F.transform("x", lambda i: F.split(i, "\n")[1]).alias("us"))
    several = parts.select("rule_id", "t", F.explode(F.filter("us", lambda u: u != "")).alias("u")).join(classes, ["t", "u"]).select("rule_id", "u", F.explode("us").alias("item"))
    several = several.join(alias.select("item", "twins"), "item").groupBy("rule_id", "u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("twins")))).alias("any"))
    several = several.groupBy("rule_id").agg(F.collect_list("any").alias("anys"), F.collect_list("u").alias("named"))
    rules = parts.join(alias.select(F.col("item").alias("t"), F.col("twins").alias("keys")), "t").join(several, "rule_id", "left")
    none = F.array().cast("array<string>")
    rules = rules.select("rule_id", F.array_sort(F.concat(F.array("t"), F.coalesce("named", none))).alias("items"), "confidence", "support", "keys", F.concat(F.array("keys"), F.coalesce("anys", F.array().cast("array<array<string>>"))).alias("needs"))
    rules = materialize(rules, "url-mined")
    release(rows, alias, kept, classes, baskets)
    return rules


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, items) -> (url, mined): the most reliable rule that each URL shows; URLs without one are left out.

    The rules are read back from a table, so that the planner knows their size and broadcasts them only if small.
    """
    index = materialize(rules, "url-rules")
    hits = urls.select("url", "items", F.explode("items").alias("key")).join(index.select(F.explode("keys").alias("key"), "needs", F.col("items").alias("rule"), "confidence"), "key")
    hits = hits.where(F.forall("needs", lambda any_of: F.arrays_overlap(any_of, "items")))
    best = F.max(F.struct("confidence", F.array_join("rule", " ").alias("name")))
    return hits.groupBy("url").agg(best.alias("m")).select("url", F.col("m")["name"].alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", how: Mining = Mining()) -> DataFrame:
    """(key, url, host, path, rule, verdict, mined) for each page. labels(key, bad): the labelled pages."""
    p = pages.select(F.col(key).alias("key"), "url")
    h, t = host(F.col("url")), path(F.col("url"))
    labelled = p.join(labels.select(F.col(key).alias("key"), "bad"), "key").select(tokens(F.col("url"), h, t).alias("items"), "bad")
    rules = mine(labelled, how)
    urls = p.select("url").where("url is not null").distinct()
    mined = match(urls.select("url", tokens(F.col("url"), h, t).alias("items")), rules)
    # pages without a URL find nothing; each has a key of its own, so that they don't meet in one task
    own = F.coalesce("url", F.concat(F.lit("\n"), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    x = p.join(mined.withColumnRenamed("url", "found"), own == F.col("found"), "left").select("key", "url", h.alias("host"), t.alias("path"), "mined")
    r = rule(F.col("host"), F.col("path"))
    return x.withColumn("r", r).select(F.col("key").alias(key), "url", "host", "path", F.col("r")["rule"].alias("rule"), F.coalesce(F.col("r")["verdict"], F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def op10(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's label is the row of labels with its number; bad: of low quality or toxic. Repeated labels count once."""
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad"))
    return judge(pages, bad).select("page_id", "host", "path", "rule", "verdict", "mined")
