"""What a text costs on its way through an ingest, and that the results are those of doing all of it."""

import hashlib
import random

import numpy as np
from docweave.functions import models
from docweave.operators import chunk as ck

PARTS = [
    *"[ ] 12[ 3. 4 artıcle ſhort İ".split(), "[ 3 ]", "\n", "\n12[", "\n Article 7 ", "\nARTICLE 2. Objectives", "\n 3. Subs. by Act", "\nCHAPTER I", "\nchapter ı ", "\nprelİminary", "PRELIMıNARY", "\n1. ſhort title", "\nSection 1. Short title ",
    "\nSection 4. Words of more than eighty characters, so that this is not taken for an entry of the contents.", "ARRANGEMENT OF CLAUSES", "words and more words of a text " * 12,
]


def test_words_are_hashed_when_they_come_up_first(monkeypatch):
    real, seen = hashlib.blake2b, []

    class Counted:
        @staticmethod
        def blake2b(word, **more):
            seen.append(word)
            return real(word, **more)

    texts = ["one two Two zwei", None, "", "two one unseen", *(f"w{i} w{i + 1}" for i in range(50))]
    monkeypatch.setattr(models, "hashlib", Counted)
    got = models.stand_in_embedding(texts, 48)
    assert len(seen) == len(set(seen)) == 55
    want = []
    for t in texts:
        v = np.zeros(48)
        for w in (t or "").lower().split():
            h = int.from_bytes(real(w.encode(), digest_size=8).digest())
            v[h % 48] += 1 if h >> 63 else -1
        want.append((v / n if (n := np.linalg.norm(v)) else v).tolist())
    assert got == want
    monkeypatch.setattr(models._Places, "most", 3)
    assert models.stand_in_embedding(texts, 48) == want and len(models._places(48)) <= 5


class Never:
    def sub(self, *_):
        raise AssertionError("the text has no sign of a match")

    search = sub


def test_patterns_are_tried_where_the_text_has_a_sign_of_them(monkeypatch):
    text = "plain words of a text without any heading, " * 20
    want = ck.chunk(text)
    monkeypatch.setattr(ck, "FOOTNOTES", [Never()] * len(ck.FOOTNOTES))
    monkeypatch.setattr(ck, "TREATY", Never())
    monkeypatch.setattr(ck, "BODY", Never())
    assert ck.chunk(text) == want and want


def test_signs_leave_no_match_out(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choice(PARTS) for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    got = [(ck.chunk(t), ck.chunk(t, "article")) for t in texts]
    monkeypatch.setattr(ck, "FOOTNOTE_SIGNS", [("",)] * len(ck.FOOTNOTES))
    monkeypatch.setattr(ck, "TREATY_SIGN", "")
    monkeypatch.setattr(ck, "BODY_SIGNS", ("",))
    assert [(ck.chunk(t), ck.chunk(t, "article")) for t in texts] == got
    assert len({str(x) for x in got}) > 500
    assert all(sum(bool(p.search(t)) for t in texts) > 20 for p in (*ck.FOOTNOTES, ck.TREATY, ck.BODY))
