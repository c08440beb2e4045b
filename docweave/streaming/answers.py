"""The answer text in a stream of model deltas, as a fold over each request's deltas in order.

`Extractor` reads one request; `extract` folds a table, `extract_stream` keeps the fold as keyed state of a streaming
query. A tag split over deltas is not seen, \\uXXXX is not decoded, and text before <think> in its delta is lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ESCAPES = {"n": "\n", "t": "\t"}
PLAIN_AFTER = 80


class Extractor:
    """States: outside an answer (collecting), inside it, after it."""

    def __init__(self, state: dict | None = None) -> None:
        self.s = state or {"phase": "before", "held": "", "escaped": False, "thinking": False}

    def feed(self, delta: str | None) -> str:
        s = self.s
        if s["phase"] == "after" or not delta:
            return ""
        s["thinking"] = s["thinking"] or "<think>" in delta
        if s["thinking"]:
            _, closed, delta = delta.partition("</think>")
            s["thinking"] = not closed
            if not delta:
                return ""
        if s["phase"] == "inside":
            return self._inside(delta)
        s["held"] += delta
        held = s["held"]
        at = held.find('"answer"')
        colon = held.find(":", at + 8) if at >= 0 else -1
        quote = held.find('"', colon + 1) if colon >= 0 else -1
        if quote >= 0:
            s["phase"], s["held"] = "inside", ""
            return self._inside(held[quote + 1 :])
        start = held.lstrip()
        if len(held) > PLAIN_AFTER and not (start.startswith(("{", "```", "[")) or '"' in start or ":" in start):
            s["phase"], s["held"] = "inside", ""
            return held
        return ""

    def _inside(self, text: str) -> str:
        out = []
        for c in text:
            if self.s["escaped"]:
                out.append(_ESCAPES.get(c, c))
                self.s["escaped"] = False
            elif c == "\\":
                self.s["escaped"] = True
            elif c == '"':
                self.s["phase"] = "after"
                break
            else:
                out.append(c)
        return "".join(out)


def _fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    e = Extractor()
    return pd.DataFrame({"request_id": [key[0]], "answer": ["".join(e.feed(d) for d in rows.sort_values("seq")["delta"])]})


def extract(deltas: DataFrame) -> DataFrame:
    """deltas(request_id, seq, delta) -> (request_id, answer). A request's deltas are one answer, so they fit a task."""
    return deltas.groupBy("request_id").applyInPandas(_fold, "request_id string, answer string")


def _stateful(rows: DataFrame, key: str, schema: str, state: str, step: Callable, expiry_ms: int | None) -> DataFrame:
    """step(key, new rows as a frame, state or None) -> (frame, new state) for each key and batch.

    A key of which nothing has come for expiry_ms milliseconds is forgotten. None, for streams that end: a trigger that
    waits for expiries, as availableNow does, would not come to an end.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(of: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        out, new = step(of[0], pd.concat(list(parts)), held.get if held.exists else None)
        held.update(new)
        if expiry_ms is not None:
            held.setTimeoutDuration(expiry_ms)
        if len(out):
            yield out

    return rows.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def _newer(rows: pd.DataFrame, last: int) -> pd.DataFrame:
    """Rows in order of seq, each once, without those at or before `last`: they were there already, or come too late."""
    rows = rows[rows["seq"] > last]
    return rows.sort_values("seq").drop_duplicates("seq")


def extract_stream(deltas: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """The same on a stream: each batch's new text of each request, and the last delta that it is from. The fold's state is
    kept between batches; deltas that come again, or after later ones, are dropped."""

    def step(request: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        fold, last = state or (None, -1)
        e, rows = Extractor(json.loads(fold) if fold else None), _newer(rows, last)
        text = "".join(e.feed(d) for d in rows["delta"])
        last = int(rows["seq"].max()) if len(rows) else last
        return pd.DataFrame({"request_id": [request], "seq": [last], "text": [text]}).iloc[: len(rows)], (json.dumps(e.s), last)

    return _stateful(deltas, "request_id", "request_id string, seq bigint, text string", "fold string, seq bigint", step, expiry_ms)


def decode_events(lines: DataFrame, raw: str = "body") -> DataFrame:
    """Server-sent events of a body: (request_id, seq, stage, payload). The unfinished last one is left out."""
    parts = F.split(F.col(raw), "\n\n")
    whole = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    data = F.transform(F.filter(whole, lambda p: p.startswith("data:")), lambda p: F.trim(F.substring(p, 6, 1_000_000_000)))
    x = lines.select("request_id", F.posexplode(data).alias("seq", "payload"))
    return x.select("request_id", "seq", F.get_json_object("payload", "$.stage").alias("stage"), "payload")


def out_of_order(events: DataFrame, stages: list[str]) -> DataFrame:
    """Events whose stage comes before that of the event ahead of it, or is unknown. `error` may come at any time."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    w = Window.partitionBy("request_id").orderBy("seq")
    x = events.where("stage <> 'error'").withColumn("place", place).withColumn("before", F.lag("place").over(w))
    return x.where((F.col("place") == 0) | (F.col("place") < F.col("before"))).select("request_id", "seq", "stage")


def out_of_order_stream(events: DataFrame, stages: list[str], expiry_ms: int | None = None) -> DataFrame:
    """The same while the events arrive: the place that a request has reached is kept between batches."""

    def step(request: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        reached, last = state or (0, -1)
        wrong, rows = [], _newer(rows, last)
        for seq, stage in zip(rows["seq"], rows["stage"], strict=True):
            if stage == "error":
                continue
            place = stages.index(stage) + 1 if stage in stages else 0
            if place == 0 or place < reached:
                wrong.append((request, int(seq), stage))
            reached = place
        return pd.DataFrame(wrong, columns=["request_id", "seq", "stage"]), (reached, int(rows["seq"].max()) if len(rows) else last)

    of = events.schema["request_id"].dataType.simpleString()
    return _stateful(events, "request_id", f"request_id {of}, seq bigint, stage string", "reached int, seq bigint", step, expiry_ms)


def recent_turns_stream(turns: DataFrame, last: int = 3, expiry_ms: int | None = None) -> DataFrame:
    """Bounded memory of a stream of turns(conv_id, turn, query): each conversation's last ones after each batch. A turn
    that comes again replaces itself."""

    def step(conversation: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        kept = dict(json.loads(state[0])) if state else {}
        kept |= {int(t): q for t, q in zip(rows["turn"], rows["query"], strict=True)}
        kept = dict(sorted(kept.items())[-last:])
        return pd.DataFrame({"conv_id": [conversation] * len(kept), "turn": list(kept), "query": list(kept.values())}), (json.dumps(list(kept.items())),)

    return _stateful(turns, "conv_id", "conv_id bigint, turn bigint, query string", "kept string", step, expiry_ms)
