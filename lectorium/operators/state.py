"""Merging the states that several devices keep of the same reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import asof


def last_writer_wins(df: DataFrame, by: list[str], at: str, tie: list[str], values: list[str]) -> DataFrame:
    """Per key the values of the row with the greatest time; on equal times that with the smallest ``tie``.

    A time that is null counts as 0. Values may be null and still win. Combined before the shuffle.
    """
    when = F.coalesce(F.col(at).cast("double"), F.lit(0.0))
    best = F.min(F.struct((-when).alias("_t"), *[F.col(c) for c in tie], F.struct(*[F.col(v) for v in values]).alias("_v"))).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, *[F.col("_best._v")[v].alias(v) for v in values], (-F.col("_best._t")).alias(at))


def translate_place(sentence: Column, edition: Column, current: Column, maps: Column) -> Column:
    """A sentence of one edition in the current one: itself, through the map, or null when it must be dropped."""
    own = F.element_at(maps, edition)
    place = F.least(F.greatest(sentence.cast("int"), F.lit(0)), F.size(own) - 1)
    same = current.isNull() | (current == "") | edition.isNull() | (edition == "") | (edition == current)
    return F.when(same, sentence).when(own.isNotNull() & (F.size(own) > 0), F.element_at(own, place + 1).cast("double"))


def compose_map(previous: Column, following: Column) -> Column:
    """An older map led on through a newer one; places are clamped."""
    last = F.size(following) - 1
    return F.transform(previous, lambda x: F.element_at(following, F.least(F.greatest(x, F.lit(0)), last) + 1))


def compose_rows(previous: DataFrame, following: DataFrame, by: list[str]) -> DataFrame:
    """Maps in rows (by, edition, place, value) led on through a newer one (by, place, value); clamped.

    For maps of any length: a join on the place. Keys without a newer map give no rows.
    """
    last = following.groupBy(*by).agg(F.max("place").alias("_last"))
    aimed = previous.join(last, by).withColumn("_at", F.least(F.greatest("value", F.lit(0)), F.col("_last")))
    there = following.select(*by, F.col("place").alias("_at"), F.col("value").alias("_to"))
    return aimed.join(there, [*by, "_at"]).select(*by, "edition", "place", F.col("_to").alias("value"))


def lead_on(maps: DataFrame, following: DataFrame, by: list[str], old_edition: Column) -> DataFrame:
    """All maps (by, edition, place, value) after another extraction: older ones led on through the new
    map (by, place, value), and that map under the name of the edition before it, if it has one."""
    older = compose_rows(maps.where(~F.col("edition").eqNullSafe(old_edition)), following, by)
    return older.unionByName(following.withColumn("edition", old_edition).where("edition <> ''"))


def keep_place(states: DataFrame, words: DataFrame, sentences: DataFrame, by: list[str]) -> DataFrame:
    """What is being heard as a sentence: (by, sent, sent_at, sent_pct), where the position is newer than the page's.

    ``states`` (by, pos, pos_at, sent_at); ``words`` (by, t0, block, cs); ``sentences`` (by, block,
    a, number). The last word that has begun (else the first), then the last sentence of its
    block that begins at or before it (else the block's first), not past the book's last.
    """
    newer = F.col("pos").isNotNull() & (F.coalesce("pos_at", F.lit(0.0)) > F.coalesce("sent_at", F.lit(0.0)))
    heard = asof(states.where(newer).select(*by, "pos", "pos_at"), words, by, "pos", "t0", ["block", "cs"], first_if_none=True).where("block is not null")
    found = asof(heard, sentences.select(*by, "block", "a", "number"), [*by, "block"], "cs", "a", ["number"], first_if_none=True)
    totals = sentences.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sent = F.least(F.coalesce("number", F.lit(0)), F.greatest(F.col("_n") - 1, F.lit(0)))
    placed = found.join(totals, by).withColumn("sent", sent)
    return placed.select(*by, "sent", F.col("pos_at").alias("sent_at"), F.bround(F.col("sent") / F.greatest("_n", F.lit(1)) * 100, 0).cast("long").alias("sent_pct"))


def retiming(has_timing: Column, moved: Column, captions: Column, playable: Column, aligned: Column, tools: Column) -> Column:
    """What becomes of a book's timing when its text is extracted again, and why if it can't be built."""
    return (
        F.when(~has_timing, "no audio")
        .when(~moved, "unchanged")
        .when(~captions, "refused: no captions")
        .when(~playable, "refused: no audio file")
        .when(aligned & ~tools, "refused: no aligner")
        .when(aligned, "rebuilt and aligned")
        .otherwise("rebuilt")
    )


def status(shelf: Column, mode_at: Column, shelf_at: Column, at_end: Column, seconds: Column) -> Column:
    """done, reading, paused or none. A shelf of another name counts as no shelf."""
    later = F.coalesce(mode_at, F.lit(0)) > F.coalesce(shelf_at, F.lit(0))
    return (
        F.when(shelf == "done", "done")
        .when(shelf == "reading", "reading")
        .when(shelf.isin("paused", "library"), F.when(later, "reading").otherwise("paused"))
        .when(at_end, "done")
        .when(F.coalesce(seconds, F.lit(0)) > 600, "reading")
        .otherwise("none")
    )


def streak(days: DataFrame, by: str, day: str, today: str) -> DataFrame:
    """Per key the consecutive days up to ``today``, or up to the day before if today is missing."""
    now = F.lit(today).cast("date")
    distinct = days.where(F.col(day) <= now).select(by, day).distinct()
    w = Window.partitionBy(by).orderBy(day)
    runs = distinct.withColumn("_run", F.date_sub(day, F.row_number().over(w)))
    ends = runs.groupBy(by, "_run").agg(F.count(F.lit(1)).alias("n"), F.max(day).alias("last"))
    alive = F.when(F.col("last") >= F.date_sub(now, 1), F.col("n")).otherwise(0)
    return ends.groupBy(by).agg(F.max(alive).alias("streak"))


def join_own(a: DataFrame, b: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Two copies of one device's state: ``b`` wins a key only with a later time."""
    x = a.select(*by, F.col(value).alias("_va"), F.col(at).alias("_ta"))
    y = b.select(*by, F.col(value).alias("_vb"), F.col(at).alias("_tb"))
    newer = F.col("_ta").isNull() | (F.col("_tb") > F.col("_ta"))
    both = x.join(y, by, "full")
    return both.select(*by, F.when(F.coalesce(newer, F.lit(False)), F.col("_vb")).otherwise(F.col("_va")).alias(value), F.greatest("_ta", "_tb").alias(at))


def join_own_days(a: DataFrame, b: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Statistics that two copies of one device's state hold per day: the larger of each, so nothing counts twice."""
    x = a.select(*by, *[F.col(v).alias(f"_a_{v}") for v in values])
    y = b.select(*by, *[F.col(v).alias(f"_b_{v}") for v in values])
    zero = F.lit(0)
    return x.join(y, by, "full").select(*by, *[F.greatest(F.coalesce(f"_a_{v}", zero), F.coalesce(f"_b_{v}", zero)).alias(v) for v in values])
