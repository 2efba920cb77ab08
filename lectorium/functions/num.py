"""Numbers and durations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


def floor_to_tenth(x: Column) -> Column:
    """Down to one decimal, with a comma, as shares are shown: 0.8456 in per cent is 84,5."""
    tenths = F.floor(F.bround(x * 1000, 6)) / 10
    return F.replace(F.format_string("%.1f", tenths), F.lit("."), F.lit(","))


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return F.least(F.greatest(x, low), high)


def clock_seconds(text: Column) -> Column:
    """``1:02:03``, ``20:34`` or ``1234.5`` in seconds; null if any part is no number."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda total, part: total * 60 + part.try_cast("double"))


def upper_index(values: Column, of_ten: int) -> Column:
    """The value at index ``n * of_ten // 10`` of an array of n in ascending order; null if empty."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(values) * of_ten / 10).cast("int"))


def matrix(*values: float) -> list[Column]:
    """The six numbers of an affine transform as columns."""
    return [F.lit(v) for v in values]


def after(first: list[Column], second: list[Column]) -> list[Column]:
    """One transform for two, the first one first."""
    a, b, c, d, e, f = first
    across = [(a, b), (c, d), (e, f)]
    rows = [(x * second[0] + y * second[2], x * second[1] + y * second[3]) for x, y in across]
    return [*rows[0], *rows[1], rows[2][0] + second[4], rows[2][1] + second[5]]


def transformed(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a transform."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def shown_size(kilobytes: Column) -> Column:
    """Kilobytes as they are shown, large ones as megabytes with one decimal."""
    large = F.replace(F.format_string("%.1f МБ", kilobytes / 1024), F.lit("."), F.lit(","))
    return F.when(kilobytes >= 1000, large).otherwise(F.concat(kilobytes.cast("string"), F.lit(" КБ")))


def shown_clock(seconds: Column) -> Column:
    """Seconds as minutes and seconds, with hours if there are any; below 0 is 0."""
    s = F.greatest(F.floor(F.coalesce(seconds, F.lit(0)) + 0.5), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.concat_ws(":", hours.cast("string"), two(minutes), two(s % 60))).otherwise(F.concat_ws(":", minutes.cast("string"), two(s % 60)))
