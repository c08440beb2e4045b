import itertools
import random
import re

from docweave.llm import url_rules as u

URLS = [
    None, "", "no scheme here", "http://", "http://com", "http://com/", "https://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://a.example.com/en/1",
    "https://example.com/EN/1", "https://notexample.com/en/1", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://net/es/", "http://xnet/es/",
    "a://b.com?q=1/en/", "a://b.com#/en/", "x y://h.net/fr/a\nb?c", "http://a://b.com/x", "ftp://example.com:80/en/", "http://ünï.COM/é", "://example.com/en/q",
]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in u.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    labels = spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint")
    got = {r["page_id"]: r for r in u.op10(pages, labels).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = brute(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), url


def test_mined_rules_match_their_combinations_only(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{'win' if bad or i % 4 == 1 else 'ok'}.site.org/{'bonus' if bad or i % 4 == 2 else 'page'}/{i}"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, "http://win.site.org/bonus/9"), (1001, "http://win.site.org/page/9"), (1002, "http://ok.site.org/bonus/9"), (1003, "http://win.site.com/bonus/9"), (None, "http://win.site.org/bonus/9")]
    labels += [(0, 0, 0), (None, 0, 1), (5000, 0, 0), (1, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r["page_id"]: r for r in u.op10(pages, spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint")).collect()}
    assert len(got) == len(rows)
    for i in range(400):
        assert got[i]["verdict"] == ("block" if i % 4 == 0 else "allow")
    assert [got[i]["verdict"] for i in (1000, 1001, 1002, 1003, None)] == ["block", "allow", "allow", "allow", "block"]


def test_long_repeated_urls_do_not_explode(spark):
    long = "http://h.org/" + "/".join("abcdefghij"[i % 10] * (i // 10 + 1) for i in range(200))
    rows = [(i, long if i < 60 else f"http://x.org/{i}") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(100)], "doc_id bigint, quality bigint, toxic bigint")
    got = u.op10(pages, labels)
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(60))


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", 1, "k"), (1, "http://a.org/x", 2, "k")], "page_id bigint, url string, host bigint, key string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality bigint, toxic bigint")
    assert u.op10(pages, labels).count() == 2
    assert u.op10(pages.limit(0), labels).count() == 0


def test_twins_of_a_rule_item_match_alone(spark):
    labelled = [(i, f"http://a.org/spam/offer/{i}") for i in range(20)] + [(100 + i, f"http://a.org/good/page{i % 3}") for i in range(40)]
    alone = [(200, "http://a.org/spam"), (201, "http://a.org/offer"), (202, "http://a.org/good"), (203, "http://a.org/other")]
    pages = spark.createDataFrame(labelled + alone, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i < 100) for i, _ in labelled], "page_id bigint, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in u.judge(pages, labels).collect()}
    assert [got[i] for i, _ in alone] == ["block", "block", "allow", "allow"]
    assert all(got[i] == ("block" if i < 100 else "allow") for i, _ in labelled)


def brute_rules(baskets, how):
    """All combinations that pass the thresholds, by enumeration."""
    n, n_bad = len(baskets), sum(b for _, b in baskets)
    found = []
    for size in (1, 2, 3, 4, 5):
        for items in itertools.combinations(sorted({x for i, _ in baskets for x in i}), size):
            rows = [b for i, b in baskets if i.issuperset(items)]
            if sum(rows) >= max(how.min_count, how.min_support * n) and sum(rows) >= how.min_confidence * len(rows) and sum(rows) * n >= how.min_lift * n_bad * len(rows):
                found.append(set(items))
    return found


def test_mined_rules_against_enumeration(spark):
    for seed in range(3):
        r = random.Random(seed)
        planted = [["alpha", "beta"], ["gamma", "delta", "eps"], ["zeta"]]
        rows, labels = [], []
        for i in range(240):
            words = {w for w in ("alpha", "beta", "gamma", "delta", "eps", "eta") if r.random() < 0.45} | ({"zeta"} if r.random() < 0.1 else set())
            bad = any(set(p) <= words for p in planted) and r.random() < 0.9 or r.random() < 0.05
            rows.append((i, "http://h.org/" + "/".join(sorted(words, key=lambda w: r.random()))))
            labels.append((i, bad))
        pages = spark.createDataFrame(rows, "page_id bigint, url string")
        how = u.Mining(min_support=0.02, min_confidence=0.7)
        got = {x["page_id"]: x["verdict"] for x in u.judge(pages, spark.createDataFrame(labels, "page_id bigint, bad boolean"), how=how).collect()}
        baskets = [({"s:http", "h:h", "h:org"} | {f"p:{w}" for w in url.split("/")[3:] if w}, bad) for (_, url), (_, bad) in zip(rows, labels, strict=True)]
        rules = brute_rules(baskets, how)
        assert rules
        assert got == {i: "block" if any(x <= items for x in rules) else "allow" for i, (items, _) in enumerate(baskets)}


def test_shared_tokens_that_stand_elsewhere_too_do_not_explode(spark):
    shared = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rows = [(i, "http://bad.org/" + "/".join(shared)) for i in range(12)] + [(100 + i, f"http://ok.org/{shared[i % 40]}") for i in range(480)] + [(1300, f"http://x.org/{shared[3]}/{shared[7]}"), (1301, f"http://x.org/{shared[3]}")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i < 100) for i, _ in rows[:-2]], "page_id bigint, bad boolean")
    got = {x["page_id"]: x["verdict"] for x in u.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i < 100 or i == 1300 else "allow") for i, _ in rows)


def test_equal_confidence_names_one_rule(spark):
    rows = [(i, "http://a.org/" + ("one" if i % 2 else "two") + "/x") for i in range(40)] + [(100 + i, "http://a.org/fine/x") for i in range(40)] + [(200, "http://a.org/one/two")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i < 100) for i, _ in rows[:-1]], "page_id bigint, bad boolean")
    got = {x["page_id"]: x["mined"] for x in u.judge(pages, labels).collect()}
    assert (got[0], got[1], got[100], got[200]) == ("p:two", "p:one", None, "p:two")
