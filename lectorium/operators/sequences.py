"""Operators over ordered rows: as-of joins, islands, sessions, gaps, monotone filters, interpolation.

All windows are partitioned; no operator orders a whole table in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], first_if_none: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before it.

    Both sides meet in one sorted stream per key, so there is no pair of rows. Ties on the
    right take the greatest values. ``first_if_none`` gives rows before the first the first.
    """
    packed = F.struct(*[F.col(v) for v in values])
    there = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), packed.alias("_value"), F.lit(None).alias("_row"))
    row = F.struct(*[F.col(c) for c in left.columns])
    here = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_value"), row.alias("_row"))
    both = here.unionByName(there)
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_value")
    found = F.last("_value", ignorenulls=True).over(w.rowsBetween(START, 0))
    if first_if_none:
        found = F.coalesce(found, F.first("_value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return both.withColumn("_found", found).where("_side = 1").select("_row.*", *[F.col("_found")[v].alias(v) for v in values])


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """``df`` with the number, from 1, of the run that each row is in; ``starts`` is true where a run begins."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(START, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def sessions(df: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """Sessions of rows less than the gap apart: user, session_start, session_end (last row), n_events."""
    s = df.groupBy(by, F.session_window(F.col(at).cast("timestamp"), f"{gap_seconds} seconds").alias("_w"))
    return s.agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count(F.lit(1)).alias("n_events")).drop("_w")


def crossings(df: DataFrame, by: list[str], order: list[str], value: str, threshold: float, most_step: float) -> DataFrame:
    """Rows at which a value passes the threshold upward by a step shorter than ``most_step``."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = df.withColumn("prev", F.lag(value).over(w))
    return before.where((F.col("prev") < threshold) & (F.col(value) >= threshold) & (F.col(value) - F.col("prev") < most_step))


def each_step(df: DataFrame, before: str, count: str, step: int, name: str) -> DataFrame:
    """A row for each multiple of ``step`` among the numbers that a row stands for: ``count`` of them from ``before`` on.

    What a join of the numbers with the ranges would give, without one.
    """
    first, last = F.ceil(F.col(before) / step), F.floor((F.col(before) + F.col(count) - 1) / step)
    held = df.where((F.col(count) > 0) & (first <= last))
    return held.withColumn(name, F.explode(F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda k: k * step)))


def running_max_only(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is no less than all before: what a filter that compares with the last row kept leaves."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(START, -1)
    return df.withColumn("_most", F.max(value).over(w)).where(F.col("_most").isNull() | (F.col(value) >= F.col("_most"))).drop("_most")


def interpolate(words: DataFrame, by: list[str], order: str, time: str, weight: Column, duration: Column, longest: float = 1.5, shortest: float = 0.05, digits: int | None = 3) -> DataFrame:
    """Times (t0, t1) for all words from those of some.

    Between two known words time goes with the weights of the words in between; before the
    first and after the last at the rate of the whole, not below 0 nor past ``duration``. A
    word ends at the next, ``longest`` later at most. Keys without any known time give no rows.
    """
    p = Window.partitionBy(*by)
    w = p.orderBy(order)
    upto, back, on = w.rowsBetween(START, 0), w.rowsBetween(START, -1), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.col(time).isNotNull()
    at = words.withColumns({"_w": weight, "_d": duration}).withColumn("_before", F.coalesce(F.sum("_w").over(back), F.lit(0)))
    at = at.withColumn("_mark", F.when(known, F.struct(F.col(time).alias("t"), F.col("_before").alias("c"))))
    at = at.withColumns(
        {
            "_a": F.last("_mark", True).over(upto),
            "_b": F.first("_mark", True).over(on),
            "_lo": F.min_by("_mark", F.when(known, F.col(order))).over(p),
            "_hi": F.max_by("_mark", F.when(known, F.col(order))).over(p),
        }
    ).where(F.col("_lo").isNotNull())
    rate = (F.col("_hi.t") - F.col("_lo.t")) / F.when(F.col("_hi.c") == F.col("_lo.c"), 1).otherwise(F.col("_hi.c") - F.col("_lo.c"))
    c = F.col("_before")
    t0 = (
        F.when(known, F.col(time))
        .when(F.col("_a").isNull(), F.greatest(F.lit(0.0), F.col("_b.t") - (F.col("_b.c") - c) * rate))
        .when(F.col("_b").isNull(), F.least(F.col("_d"), F.col("_a.t") + (c - F.col("_a.c")) * rate))
        .otherwise(F.col("_a.t") + (c - F.col("_a.c")) * (F.col("_b.t") - F.col("_a.t")) / (F.col("_b.c") - F.col("_a.c")))
    )
    timed = at.withColumn("t0", t0)
    end = F.least(F.coalesce(F.lead("t0").over(w), F.col("_d")), F.col("t0") + longest)
    timed = timed.withColumn("t1", F.when(end <= F.col("t0"), F.col("t0") + shortest).otherwise(end))
    cut = (lambda c: F.col(c)) if digits is None else lambda c: F.bround(c, digits)
    return timed.select(*words.columns, cut("t0").alias("t0"), cut("t1").alias("t1"))


def fix_times(df: DataFrame, by: str, order: str, value: str, step: float = 0.01) -> DataFrame:
    """A value below the one before it, as fixed, becomes that one and ``step``; each fix can bring the next."""

    def work(pdf):
        pdf = pdf.sort_values(order)
        fixed, last = [], None
        for v in pdf[value]:
            if last is not None and v < last:
                v = last + step
            fixed.append(v)
            last = v
        return pdf.assign(fixed=fixed)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(by).applyInPandas(work, f"{fields}, fixed double")


def greedy_windows(df: DataFrame, by: str, order: str, start: str, end: str, duration: Column, length: float = 120.0, slack: float = 5.0) -> DataFrame:
    """Windows of about ``length`` between anchors: a window ends at the first anchor that long after its first one, which begins the next.

    Rows: ``window_no``, words from ``word_lo`` to ``word_hi`` (both in it), times from ``t_lo``
    to ``t_hi``. The last window holds its last anchor and goes on ``slack`` past its end, to the
    duration at most. One anchor alone is no window.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        words, begins = pdf[order].to_numpy(), pdf[start].to_numpy()
        final, rows, i = len(pdf) - 1, [], 0
        while i < final:
            later = np.nonzero(begins[i + 1 : final] - begins[i] >= length)[0]
            j = i + 1 + int(later[0]) if len(later) else final
            closing = j == final
            hi = words[j] if closing else words[j] - 1
            until = min(pdf["_duration"].iloc[0], pdf[end].iloc[j] + slack) if closing else begins[j]
            rows.append((pdf[by].iloc[0], len(rows), words[i], hi, begins[i], until))
            i = j
        return pd.DataFrame(rows, columns=[by, "window_no", "word_lo", "word_hi", "t_lo", "t_hi"])

    kind = df.schema[by].dataType.simpleString()
    narrow = df.select(by, F.col(order).cast("long").alias(order), F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end), duration.cast("double").alias("_duration"))
    return narrow.groupBy(by).applyInPandas(work, f"`{by}` {kind}, window_no int, word_lo long, word_hi long, t_lo double, t_hi double")


def aligned_times(words: DataFrame, by: list[str], order: str, duration: Column, longest: float = 1.5, shortest: float = 0.05, worst: float = -8.0) -> DataFrame:
    """Times (t0, t1) of words that an aligner gave some of: ``found0``, ``found1``, ``score``, else ``given0``, ``given1``.

    What scores below ``worst`` is not taken. A found word lasts ``shortest`` at least. Begins are
    then made to rise (``fix_times``) and ends held between the begin, the next one and ``longest``.
    """
    good = F.coalesce(F.col("score") >= worst, F.lit(False)) & F.col("found0").isNotNull()
    end = F.when(F.col("found1") <= F.col("found0"), F.col("found0") + shortest).otherwise(F.col("found1"))
    taken = words.select(*by, order, duration.alias("_d"), F.when(good, F.col("found0")).otherwise(F.col("given0")).alias("_t0"), F.when(good, end).otherwise(F.col("given1")).alias("_t1"))
    risen = fix_times(taken.withColumn("_key", F.struct(*by)), "_key", order, "_t0").drop("_key")
    w = Window.partitionBy(*by).orderBy(order)
    t1 = F.least(F.greatest(F.col("_t1"), F.col("fixed") + shortest), F.coalesce(F.lead("fixed").over(w), F.col("_d")), F.col("fixed") + longest)
    return risen.select(*by, order, F.bround("fixed", 3).alias("t0"), F.bround(t1, 3).alias("t1"))


def nearest_above(df: DataFrame, by: list[str], order: str, level: str, levels: int, value: str, name: str = "parent") -> DataFrame:
    """``df`` with the ``value`` of the last row before of a lower level, for levels from 0 to ``levels`` - 1; null if there is none."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(START, -1)
    # Of each level the last row; the latest of those below the own level.
    last = [F.max(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).over(w) for k in range(levels - 1)]
    found = df.withColumn("_last", F.array(*last)) if last else df.withColumn("_last", F.array())
    return found.withColumn(name, F.array_max(F.slice("_last", F.lit(1), F.least(F.col(level), F.lit(levels - 1)).cast("int")))["v"]).drop("_last")
