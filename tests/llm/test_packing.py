import zlib
from collections import defaultdict

import numpy as np
import pytest
from docweave.llm import packing as p

from helpers import AWKWARD, documents, words


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(p.default_vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


ROWS = AWKWARD + [(100 + i, " ".join(words(i, 40 * i + 1))) for i in range(40)] + [(300, " ".join(words(7, 30_000))), (301, "x" * 9000), (302, " " * 9000 + "<|endoftext|> né")]


def test_round_trip(spark, tokenizer):
    pieces = p.pack(documents(spark, ROWS), with_ids=True).collect()
    assert_sequences(pieces)
    want = defaultdict(list)
    for i, t in ROWS:
        want[i].append(ids_of(tokenizer, t))
    by_doc = defaultdict(list)
    for r in pieces:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] > 0
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(want)
    for i, rows in by_doc.items():
        expected = [(t.tolist() if hasattr(t, "tolist") else t) for t in want[i]]
        total = sum(r["length"] for r in rows)
        assert total == sum(map(len, expected))
        if len(expected) == 1:
            rows.sort(key=lambda r: r["start"])
            assert [x for r in rows for x in r["ids"]] == expected[0]
            assert all(r["doc_tokens"] == len(expected[0]) for r in rows)
            assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["length"] for r in rows[:-1]]))


def assert_sequences(pieces):
    by_seq = defaultdict(list)
    for r in pieces:
        by_seq[r["sequence_id"]].append(r)
    padding = total = 0
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at <= p.LENGTH
        total += at
        padding += 0 if at & (at - 1) == 0 else p.LENGTH - at
    assert padding == 0 < total


def test_query_and_lower_costs_first(spark):
    assert_sequences(p.op8(documents(spark, ROWS)).collect())
    big = p.assign([1000, 900, 100, 48])
    assert {(x[0], x[3]) for x in big if x[2] > 90} == {(0, 0), (1, 1), (2, 1)}


def test_layout():
    for total in (0, 1, 1023, 1024, 1025, 5000):
        lengths = p.layout(total)
        assert sum(lengths) == total and all(n & (n - 1) == 0 for n in lengths)


def test_empty_and_clashing(spark):
    docs = documents(spark, AWKWARD)
    assert p.op8(docs.limit(0)).count() == 0
    odd = docs.selectExpr("*", "'a' as start", "'b' as tail", "0 as crcs")
    assert p.op8(odd).select("doc_id").distinct().count() == 8
