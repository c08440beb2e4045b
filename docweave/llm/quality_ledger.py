"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text; the ledger keeps its failure bits and its measurements. Policies are
versioned masks over those bits, so that a new policy, or an ablation of one rule, needs no second look at a text.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged alike, row by row;
an empty table gives an empty ledger; other columns pass through `ledger` untouched, whatever their names
(only `ledger_column` is reserved).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, bound_batches, chunks, window_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5

#: Measurements kept for each text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: A bit for each rule, in this order; a rule keeps its bit for good, new ones come last.
RULES = ("few_words", "repeats", "symbols", "shouting", "dup_lines", "word_length")
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeats"]


@dataclass(frozen=True)
class Policy:
    """version: its name; mask: the rules that count; allowed: failures it bears among them."""

    version: str
    mask: int
    allowed: int = 0


POLICIES = {
    "v1": Policy("v1", sum(BIT.values())),
    "base": Policy("base", BASE),
}
DEFAULT_POLICY = "v1"

_TYPE = pa.struct([(m, pa.int64()) for m in MEASURES])
_SQL_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def measure(texts: list[bytes]) -> np.ndarray:
    """A row of MEASURES for each UTF-8 text."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    hashes = WordHashes()
    for start, stop in chunks(texts):
        words, counts = [], []
        for i in range(start, stop):
            t = texts[i]
            w = t.split()
            counts.append(len(w))
            words += w
            row = out[i]
            row[0] = len(w)
            row[1] = _points(t)
            row[2] = len(t) - len(t.translate(None, SYMBOLS))
            if b"\n" in t:
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                row[3], row[5] = len(lines) - len(set(lines)), len(lines)
            else:
                row[5] = bool(w)
            row[6] = len(t) - len(t.translate(None, _UPPER))
            row[7] = len(t) - len(t.translate(None, _LETTERS))
        out[start:stop, 4] = _repeats(hashes.array(words), np.array(counts))
    return out


def _points(t: bytes) -> int:
    """Code points outside white space."""
    t = t.translate(None, SPACES)
    return len(t) if t.isascii() else len(t.decode())


def _repeats(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the words in windows that its text has twice or more. words: all texts' words in turn."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    windows = window_hashes(words, WINDOW)
    inside = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    keys = windows[inside] + text[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    at = inside[twice]
    edge[:n] += np.bincount(at, minlength=n).astype(np.int32)[:n]
    edge += -np.bincount(at + WINDOW, minlength=n + 1).astype(np.int32)[: n + 1]
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(text[covered], minlength=len(counts))


def _udf():
    def measured(text: pa.Array) -> pa.Array:
        rows = measure(as_bytes(text))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(MEASURES))], list(MEASURES))

    return F.arrow_udf(measured, _SQL_TYPE)


def failures(m: Column) -> Column:
    """The failure bits of measurements m. Every rule compares integers, so that a bit is the same everywhere."""
    fails = {
        "few_words": m["n_words"] < 10,
        "repeats": 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": 4 * m["n_symbols"] > m["n_words"],
        "shouting": (m["n_letters"] >= 40) & (2 * m["n_upper"] > m["n_letters"]),
        "dup_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": (m["word_chars"] > 30 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]),
    }
    bits = F.lit(0).cast("bigint")
    for name in RULES:
        bits = bits.bitwiseOR(F.when(fails[name], F.lit(BIT[name]).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def ledger(docs: DataFrame, text: str = "text", ledger_column: str = "_ledger") -> DataFrame:
    """docs with a struct column: failure bits and measurements. One Arrow pass, no shuffle."""
    bound_batches(docs.sparkSession)
    measured = docs.withColumn(ledger_column, _udf()(F.col(text)))
    m = F.col(ledger_column)
    return measured.withColumn(ledger_column, F.struct(failures(m).alias("bits"), *(m[x].alias(x) for x in MEASURES)))


def verdict(bits: Column, policy: Policy) -> Column:
    """True where a text passes: at most policy.allowed of its failures count."""
    counted = bits.bitwiseAND(F.lit(policy.mask))
    return F.bit_count(counted) <= policy.allowed


def ablation(ledgered: DataFrame, policy: Policy, ledger_column: str = "_ledger") -> DataFrame:
    """For each rule of a policy: how many texts fail it, fail it alone, and pass once it is left out.

    The texts are first counted by their bits, of which there are at most 2^rules, so that one small aggregate serves
    every ablation.
    """
    by_bits = ledgered.groupBy(F.col(ledger_column)["bits"].alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r, b) for r, b in BIT.items() if b & policy.mask]
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for r, b in rules)))
    x = by_bits.select("bits", "n", rows.alias("r")).select("bits", "n", "r.*")
    counted = F.col("bits").bitwiseAND(F.lit(policy.mask))
    without = counted.bitwiseAND(F.bitwise_not(F.col("bit")))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return x.groupBy("rule", "bit").agg(
        n(counted.bitwiseAND(F.col("bit")) != 0)("n_failed"),
        n(counted == F.col("bit"))("n_only"),
        n(F.bit_count(counted) <= policy.allowed)("n_kept"),
        n(F.bit_count(without) <= policy.allowed)("n_kept_without"),
    )


def op2(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    x = ledger(docs.select("doc_id", "text"))
    m = F.col("_ledger")
    base_failed = m["bits"].bitwiseAND(F.lit(BASE)) != 0
    return x.select(
        "doc_id",
        *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed.alias("base_failed"),
        (~base_failed & verdict(m["bits"], POLICIES[policy])).alias("kept"),
        m["bits"].alias("failure_bits"),
    )
