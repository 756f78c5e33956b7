"""Keyed event operators. Each has a batch form and, where it keeps state, a streaming form with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def debounced(events: DataFrame, key: str, ts: str, payload: str, delay: str, lateness: str | None = None) -> DataFrame:
    """Trailing debounce: of events of a key less than `delay` apart, the last fires, `delay` after it.

    key, fires_at, payload, events. The same plan serves batch and stream; a stream needs a bound of lateness.
    """
    if lateness:
        events = events.withWatermark(ts, lateness)
    session = F.session_window(ts, delay)
    return events.groupBy(key, session.alias("w")).agg(F.max_by(payload, ts).alias("payload"), F.count("*").alias("events")).select(key, F.col("w.end").alias("fires_at"), "payload", "events")


def searches(terms: DataFrame, delay: float = 0.25) -> DataFrame:
    """Debounced searches of each user: a term applies `delay` seconds after it if no other follows by then; an empty one at once.

    terms: user_id, at (seconds), seq, term; the result has applies_at.
    """
    following = F.lead("at").over(Window.partitionBy("user_id").orderBy("at", "seq"))
    timed = terms.withColumn("following", following)
    applied = timed.filter((F.col("term") == "") | F.col("following").isNull() | (F.col("following") - F.col("at") >= delay))
    return applied.select("user_id", "seq", "term", (F.col("at") + F.when(F.col("term") == "", 0.0).otherwise(F.lit(delay))).alias("applies_at"))


def changes(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("__before", before).filter(~F.col(value).eqNullSafe(F.col("__before"))).drop("__before")


def last_states(events: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """Each key's state after its last event."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(ts, state)).alias("state"))


THROTTLED = "key string, at double, accepted boolean"


def _accept(times: list[float], last: float | None, gap: float) -> tuple[list[bool], float | None]:
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        last = t if ok else last
        out.append(ok)
    return out, last


def throttled(events: DataFrame, gap: float) -> DataFrame:
    """Leading throttle: an event (key, at in seconds) is accepted when the last accepted one is `gap` or more before it.

    A key's events pass in order through one task in bounded parts, its last accepted time carried along.
    """

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            accepted = []
            for k, t in zip(b["key"].tolist(), b["at"].tolist(), strict=True):
                if k != key:
                    key, last = k, None
                (ok,), last = _accept([t], last, gap)
                accepted.append(ok)
            yield b.assign(accepted=accepted)[["key", "at", "accepted"]]

    return events.select("key", "at").repartition("key").sortWithinPartitions("key", "at").mapInPandas(in_order, THROTTLED)


def throttled_stream(events: DataFrame, gap: float) -> DataFrame:
    """The same on a stream: the state is a key's last accepted time."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("at")
        ok, last = _accept(rows["at"].tolist(), last, gap)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": rows["key"], "at": rows["at"], "accepted": ok})

    return events.select("key", "at").groupBy("key").applyInPandasWithState(run, THROTTLED, "last double", "append", GroupStateTimeout.NoTimeout)


def stale_counts(checks: DataFrame, limit: int = 3) -> DataFrame:
    """key, misses, removed: misses in a row up to the last check (key, seq, accessible); at `limit` a file is removed and its count begins anew.

    A run of misses begins after each hit, so a window does what the counter does.
    """
    run = Window.partitionBy("key").orderBy("seq")
    runs = checks.withColumn("run", F.sum(F.col("accessible").cast("int")).over(run)).filter("not accessible").groupBy("key", "run").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    last = checks.groupBy("key").agg(F.max("seq").alias("last"))
    met = last.join(runs, "key", "left")
    current = F.max(F.when(F.col("seq") == F.col("last"), F.col("n") % limit))
    return met.groupBy("key").agg(F.coalesce(current, F.lit(0)).cast("long").alias("misses"), F.coalesce(F.sum(F.expr(f"n div {limit}")), F.lit(0)).cast("long").alias("removed"))


UNDO = "key string, undo array<string>, redo array<string>"


def _replay(log: list[tuple[str, str | None]], undo: list[str], redo: list[str], cap: int) -> tuple[list[str], list[str]]:
    for action, op in log:
        if action == "do":
            undo, redo = [*undo, op][-cap:], []
        elif action == "undo" and undo:
            undo, redo = undo[:-1], [*redo, undo[-1]]
        elif action == "redo" and redo:
            undo, redo = [*undo, redo[-1]][-cap:], redo[:-1]
    return undo, redo


def undo_stacks(log: DataFrame, cap: int = 50) -> DataFrame:
    """key, undo and redo stacks after a log (key, seq, action do/undo/redo, op). A new operation empties the redo stack; the oldest goes beyond the cap."""

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, undo, redo, seen = None, [], [], False
        for b in batches:
            done = []
            for k, action, op in zip(b["key"].tolist(), b["action"].tolist(), b["op"].tolist(), strict=True):
                if seen and k != key:
                    done.append((key, undo, redo))
                    undo, redo = [], []
                key, seen = k, True
                undo, redo = _replay([(action, op)], undo, redo, cap)
            yield pd.DataFrame(done, columns=["key", "undo", "redo"])
        if seen:
            yield pd.DataFrame([(key, undo, redo)], columns=["key", "undo", "redo"])

    return log.select("key", "seq", "action", "op").repartition("key").sortWithinPartitions("key", "seq").mapInPandas(in_order, UNDO)


def undo_stream(log: DataFrame, cap: int = 50) -> DataFrame:
    """The same on a stream: after each batch, the stacks of the keys it touched."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        undo, redo = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(parts)).sort_values("seq")
        undo, redo = _replay(list(zip(rows["action"], rows["op"], strict=True)), undo, redo, cap)
        state.update((undo, redo))
        yield pd.DataFrame([(key[0], undo, redo)], columns=["key", "undo", "redo"])

    return log.groupBy("key").applyInPandasWithState(run, UNDO, "undo array<string>, redo array<string>", "update", GroupStateTimeout.NoTimeout)


def saves(payloads: DataFrame, lateness: str | None = None) -> DataFrame:
    """Debounced saves by document (doc_id, ts, payload): one document's save never cancels another's."""
    return debounced(payloads, "doc_id", "ts", "payload", "1 second", lateness)
