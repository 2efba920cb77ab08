"""Streaming forms of reading activity: sessions, last-writer-wins state, additive statistics, crossings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_stream(events: DataFrame, by: str = "user_id", at: str = "ts", gap: str = "10 minutes", late: str = "1 hour", shortest: int = 2) -> DataFrame:
    """Sessions of a stream, with the time that may pass until a late event; those under ``shortest`` seconds go."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    s = timed.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count(F.lit(1)).alias("n_events"))
    return s.where(F.unix_micros("session_end") - F.unix_micros("session_start") >= shortest * 1_000_000).drop("w")


def daily_stream(sessions: DataFrame, by: list[str], sec: str, words: str) -> DataFrame:
    """Seconds and words per day; negative ones count as none. For update or complete mode."""
    zero = F.lit(0.0)
    return sessions.groupBy(*by).agg(F.sum(F.greatest(zero, F.coalesce(sec, zero))).alias("sec"), F.sum(F.greatest(zero, F.coalesce(words, zero))).alias("words"))


def accept_writes(writes: DataFrame, by: list[str] = ["user_id", "key"]) -> DataFrame:  # noqa: B006
    """The state of each key after each batch that changed it: (keys, value, at_ms).

    A write is taken when its time is not before the stored one, so of equal times the later
    write holds; a null time is none. State is kept for every key, without a time limit, as
    the writes' own times decide and not when they come.
    """
    kinds = ", ".join(f"`{c}` {writes.schema[c].dataType.simpleString()}" for c in by)
    value = writes.schema["value"].dataType.simpleString()

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, 0.0)
        before = held
        rows = pd.concat(list(batches))
        for v, t in zip(rows.sort_values("seq")["value"], rows.sort_values("seq")["at_ms"]):
            if t == t and t is not None and t >= held[1]:
                held = (v, float(t))
        state.update(held)
        if held != before or not before[0]:
            yield pd.DataFrame([(*key, *held)], columns=[*by, "value", "at_ms"])

    return writes.groupBy(*by).applyInPandasWithState(take, f"{kinds}, value {value}, at_ms double", f"value {value}, at_ms double", "update", GroupStateTimeout.NoTimeout)


def crossing_stream(ticks: DataFrame, threshold: float, most_step: float, by: str = "user_id") -> DataFrame:
    """Ticks (user, seq, value) at which a value passes the threshold by a small step; the last tick is kept."""
    kind = ticks.schema[by].dataType.simpleString()

    def find(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        found = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, value in zip(rows["seq"], rows["value"]):
            if last is not None and last < threshold <= value and value - last < most_step:
                found.append((key[0], seq, last, value))
            last = float(value)
        state.update((last,))
        yield pd.DataFrame(found, columns=[by, "seq", "prev", "value"])

    return ticks.groupBy(by).applyInPandasWithState(find, f"`{by}` {kind}, seq long, prev double, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def translate_late(writes: DataFrame, editions: DataFrame) -> DataFrame:
    """Writes of other editions carried over by a static table (edition, current, map), or dropped; see ``translate_place``."""
    from ..operators.state import translate_place

    known = writes.join(editions, "edition", "left")
    maps = F.when(F.col("map").isNotNull(), F.create_map("edition", "map"))
    place = translate_place(F.col("value"), F.col("edition"), F.col("now"), maps)
    return known.withColumn("value", place).where("value is not null").drop("map")


def keep_last_good(states: DataFrame, by: str = "device") -> DataFrame:
    """The last readable state of each device: rows (device, seq, state) whose state is null change nothing."""
    kind = states.schema[by].dataType.simpleString()

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, text in zip(rows["seq"], rows["state"]):
            if text is not None and text == text and seq >= held[1]:
                held = (text, int(seq))
        if held[0] is not None:
            state.update(held)
            yield pd.DataFrame([(key[0], *held)], columns=[by, "state", "seq"])

    return states.groupBy(by).applyInPandasWithState(keep, f"`{by}` {kind}, state string, seq long", "state string, seq long", "update", GroupStateTimeout.NoTimeout)


def replanned(changes: DataFrame, copies: Callable[[], DataFrame], put: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """A round of syncing planned anew after each batch of changes: ``put`` gets what is to be copied by then.

    ``copies`` reads the table of copies as it is (see ``operators.library.to_sync``). Changes
    that come together make one plan; a batch that fails is planned again from the checkpoint.
    """
    from ..operators.library import to_sync

    def plan(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            put(to_sync(copies()))

    return changes.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(sessions: DataFrame, put: Callable[[list], None], checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Sessions handed on in their order. Where ``put`` fails the query stops with its error, and the next one begins with the same sessions, so none is lost and none overtakes another."""

    def hand_on(batch: DataFrame, number: int) -> None:
        rows = batch.orderBy(order).collect()  # one reader's unsaved sessions
        if rows:
            put(rows)

    return sessions.writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
