import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from docweave.llm import pii

from helpers import AWKWARD, documents, words


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    t, out = text or "", []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if [True, all(int(p) < 256 for p in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, f"{pii.KINDS[k]}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [
    "a@b.c_d@e.f x@y z@.com @a.b é.f@g-h.io, q@r.s.t. u@v.w@x.y ..@-.- A%B+c@D.E",
    "1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1.1 01.002.255.0000255 1.2.3 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 1 2 12",
    "+1 (743) 555-3824 +1 5 +123456789 +12345678901234567 ++1 234 567 890) +1----------",
    "é" * 30 + " +44 20 7946 0958 and 4316522678525456 1.1.1.1 me@x.org",
]


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice("a1b.@+- ()9é4\n%") for _ in range(400))


def test_base_against_brute_force(spark):
    rows = AWKWARD + [(50 + i, t) for i, t in enumerate(TEXTS)] + [(100 + i, noise(i)) for i in range(60)] + [(300, "9" * 20_000 + " a" * 9000 + "." * 9000 + "@" * 9000)]
    got = sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.op1(documents(spark, rows)).collect())
    want = []
    for i, t in rows:
        b = brute(t)
        n = Counter(x.split(":")[0] for x in b)
        want.append((str(i), hashlib.sha256(",".join(b).encode()).hexdigest(), *(n[k] for k in pii.KINDS)))
    assert got == sorted(want)


def corpus():
    rows = [(i, "\n".join(" ".join(words(10 * i + j, 12, 60)) for j in range(4))) for i in range(80)]
    for i in range(6):
        rows.append((200 + i, " ".join(words(900 + i, 5, 60)) + f" Zorbalin, mail z@zorb.example or w{i} often-quoted " + " ".join(words(800 + i, 5, 60))))
    rows += [(300 + i, "the chance neighbour Quillfeather of c@d.example") for i in range(5)]
    rows += [(400, "later Zorbalin came alone é zorbalin"), (401, "often quoted elsewhere mail\n" * 60)]
    return rows


def expected(rows):
    """The method by its definition, over plain Python contexts."""
    n, nt, nc, both, seen = 0, Counter(), Counter(), Counter(), defaultdict(set)
    for _, t in rows:
        for line in (t or "").split("\n"):
            spans = [x.split(":") for x in brute(line)]
            flat = list(line)
            for _, a, b in spans:
                flat[int(a) : int(b)] = " " * (int(b) - int(a))
            w = re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", "".join(c.lower() if c.isascii() else c for c in flat)).split()
            assert len(w) <= pii.BLOCK or not spans
            for i in range(0, len(w), pii.BLOCK):
                block = {x for x in w[i : i + pii.BLOCK] if len(x.encode()) >= 3}
                ents = {(k, line[int(a) : int(b)].lower()) for k, a, b in spans}
                n += 1
                nt.update(block)
                nc.update(ents)
                for e in ents:
                    for x in block:
                        both[e, x] += 1
                        seen[e, x].add(tuple(w))
    out = {}
    for (e, x), k in both.items():
        if len(seen[e, x]) >= 3:
            ratio = math.log2(k * n / nc[e] / nt[x]) / math.log2(n / nc[e])
            out[x] = max(out.get(x, -9), ratio)
    return {x: "remove" if r >= 0.95 else "generalise" for x, r in out.items() if r >= 0.8}


def test_disclosing_terms(spark):
    rows = corpus()
    docs = documents(spark, rows)
    got = {r["term"]: r["action"] for r in pii.disclosing_terms(docs).collect()}
    assert got == expected(rows)
    assert "zorbalin" in got and "quillfeather" not in got and "often" not in got


def test_terms_are_found_everywhere_and_both_ways(spark):
    docs = documents(spark, corpus() + AWKWARD)
    a = {str(r["doc_id"]): r["spans"] for r in pii.op1(docs).collect()}
    assert re.fullmatch(r"(generalise|remove):6:14,(generalise|remove):28:36", a["400"])
    b = {str(r["doc_id"]): r["spans"] for r in pii.op1(docs, pii.Disclosure(most_broadcast=0)).collect()}
    assert a == b


def test_sanitised_texts(spark):
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, corpus() + [(500, None)])).collect()}
    assert "z@zorb.example" not in got[200] and "[email]" in got[200] and "orbalin" not in got[400] and got[500] is None
    assert got[300] == "the chance neighbour Quillfeather of [email]"


def test_empty_and_clashing(spark):
    docs = documents(spark, AWKWARD)
    assert pii.op1(docs.limit(0)).count() == 0
    assert pii.op1(docs.selectExpr("*", "1 as term", "'m' as mark", "3 as kind", "4 as spans")).count() == len(AWKWARD)
