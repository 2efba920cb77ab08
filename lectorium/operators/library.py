"""Keeping a library: inserts, updates, deletions, copies and what to copy next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_unless_title(rows: DataFrame, new: DataFrame, title: str) -> DataFrame:
    """``rows`` and those of ``new`` whose title, whatever its case, is not there."""
    known = rows.select(F.lower(title).alias("_t")).distinct()
    fresh = new.join(known, F.lower(new[title]) == F.col("_t"), "left_anti")
    return fresh.unionByName(rows)


def update_by_id(rows: DataFrame, patch: DataFrame, key: str, columns: list[str], required: str | None = None) -> DataFrame:
    """``rows`` with the given columns of ``patch``; nulls leave what is there, and so does a blank ``required``."""
    new = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(new, rows[key] == F.col("_k"), "left")
    given = {c: F.when(F.trim(f"_{c}") != "", F.col(f"_{c}")) if c == required else F.col(f"_{c}") for c in columns}
    return joined.select(*[F.coalesce(given[c], F.col(c)).alias(c) if c in given else F.col(c) for c in rows.columns])


def delete_by(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def copy_state(here: Column, edition_here: Column, edition: Column, files_here: Column, files: Column) -> Column:
    """absent, outdated, here or textOnly; file maps are compared by their sorted entries."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return F.when(~here, "absent").when(edition_here != edition, "outdated").when(F.size(files_here) == 0, "textOnly").when(entries(files_here) == entries(files), "here").otherwise("outdated")


def to_sync(copies: DataFrame) -> DataFrame:
    """Books to be copied: none that is skipped, done, or failed before with the same signature; those that are absent, and the outdated ones that are not in use.

    ``copies`` has state, skipped, done, busy, signature and failed_signature.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    failed = F.coalesce(F.col("failed_signature") == F.col("signature"), F.lit(False))
    wanted = (F.col("state") == "absent") | (F.col("state") == "outdated") & ~known("busy")
    return copies.where(~known("skipped") & ~known("done") & ~failed & wanted)


def greedy_fit(items: Column, room: Column, margin: int, factor: int = 2) -> Column:
    """Of structs (id, size) in order, the ids taken while ``factor`` times the size fits what is left of ``room`` less ``margin``; one that doesn't fit is passed over."""
    start = F.struct((room - margin).cast("double").alias("left"), F.array().cast("array<long>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["size"] * factor <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(items, start, step, lambda acc: acc["ids"])


def pack_files(df: DataFrame, by: list[str], order: str, name: Column, size: Column) -> DataFrame:
    """``name:size`` of a group's files in order, joined by commas."""
    entry = F.struct(F.col(order).alias("o"), F.concat_ws(":", name.cast("string"), size.cast("string")).alias("f"))
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["f"]), ",").alias("files"))


def merge_parts(parts: DataFrame, by: list[str], order: str, counts: list[str]) -> DataFrame:
    """Per part the offsets that its numbers get when parts become one: sums of the counts before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({f"{c}_offset": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts})


def text_loss(old: DataFrame, new: DataFrame, by: list[str], least: float = 0.97) -> DataFrame:
    """Words and pictures that a new extraction lost, and whether it is refused: fewer than ``least`` of the words, or any picture.

    Blocks (by, words, picture); a null picture is none. Books that the new text lacks have lost everything.
    """
    words = lambda df, name: df.groupBy(*by).agg(F.coalesce(F.sum("words"), F.lit(0)).alias(name))
    shown = lambda df: df.where("picture is not null").select(*by, "picture").distinct()
    lost = shown(old).join(shown(new), [*by, "picture"], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("_lost"))
    both = words(old, "old_words").join(words(new, "new_words"), by, "left").join(lost, by, "left")
    counted = both.select(*by, "old_words", F.coalesce("new_words", F.lit(0)).alias("new_words"), F.coalesce("_lost", F.lit(0)).alias("pictures_lost"))
    return counted.withColumn("refused", (F.col("new_words") < least * F.col("old_words")) | (F.col("pictures_lost") > 0))


def free_name(name: str, taken: set[str]) -> str:
    """The name, or with the least of ``-2``, ``-3`` and so on that is not taken."""
    from itertools import chain, count

    return next(x for x in chain([name], (f"{name}-{k}" for k in count(2))) if x not in taken)


def move_books(mine: DataFrame, there: DataFrame) -> DataFrame:
    """Books (id, slug, movable) moved into a library of books (id, slug): ``outcome`` and ``target``.

    already: the library has the id, and ``target`` is that book, into which the reader's state
    goes; an empty id is none. moved: under the own slug or a free name made of it. failed: as
    moved, but the book could not be; it keeps the name from others. Names are settled in the
    order of the slugs, among those that differ only in number endings.
    """
    ids = there.where("id <> ''").groupBy("id").agg(F.min("slug").alias("_there"))
    known = mine.join(ids, "id", "left")
    already = known.where("_there is not null").select("id", "slug", F.lit("already").alias("outcome"), F.col("_there").alias("target"))
    stem = lambda c: F.regexp_replace(c, r"(-[0-9]+)+$", "")
    names = there.select(stem("slug").alias("_stem"), "slug").groupBy("_stem").agg(F.collect_set("slug").alias("_taken"))
    going = known.where("_there is null").withColumn("_stem", stem("slug")).join(names, "_stem", "left")
    kind = mine.schema["id"].dataType.simpleString()

    def settle(pdf):
        pdf = pdf.sort_values("slug")
        taken = set(pdf["_taken"].iloc[0]) if pdf["_taken"].iloc[0] is not None else set()
        targets = []
        for slug in pdf["slug"]:
            targets.append(free_name(slug, taken))
            taken.add(targets[-1])
        outcome = pdf["movable"].map(lambda ok: "moved" if ok else "failed")
        return pdf.assign(outcome=outcome, target=targets)[["id", "slug", "outcome", "target"]]

    moved = going.select("_stem", "id", "slug", "movable", "_taken").groupBy("_stem").applyInPandas(settle, f"id {kind}, slug string, outcome string, target string")
    return already.unionByName(moved)


def listing(books: DataFrame) -> DataFrame:
    """A library's rows with what follows from a book's files and its reader's state.

    ``books`` has slug; whether files are there (m4a, mp3, webm, timing, text, hits); cover;
    length in seconds; building, added; opened, pos, pct, sec and mode of the state. The
    audio is the best of the three kinds, ready to be heard with a timing. A book read as
    pages is at its end at 99 per cent, one that is heard a minute before the end.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = F.lit(0.0)
    audio = F.when(known("m4a"), "audio.m4a").when(known("mp3"), "audio.mp3").when(known("webm"), "yt.webm")
    duration = F.when(known("timing"), F.col("length")).otherwise(zero)
    pos, percent = F.coalesce("pos", zero), F.coalesce("pct", zero)
    at_end = F.when((duration == 0) | (F.col("mode") == "pages"), percent >= 99).otherwise(pos >= duration - 60)
    return books.select(
        "slug",
        known("text").alias("ready"),
        audio.alias("audio"),
        (audio.isNotNull() & known("timing")).alias("has_audio"),
        "building",
        "added",
        known("hits").alias("has_hits"),
        F.concat(F.lit("images/"), F.col("cover")).alias("cover"),
        F.coalesce("opened", F.lit(0)).alias("opened"),
        pos.alias("pos"),
        duration.alias("duration"),
        F.round(percent, 6).alias("sent_pct"),
        "mode",
        F.round(F.coalesce("sec", zero), 4).alias("seconds"),
        at_end.alias("at_end"),
    )
