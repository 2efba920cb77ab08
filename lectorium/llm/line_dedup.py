"""Line deduplication by the number of sites that a line is on.

Each line's sites go into a HyperLogLog sketch under the line's 128-bit hash; sketches
merge by aggregation. Lines whose estimate is clear of the threshold are settled by it.
For those near the threshold the distinct sites themselves are counted. Of a line that is
on many sites, one occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, few, fresh

MIN_SITES = 10
#: Base-2 logarithm of a sketch's registers: a relative standard error of 1.6 %.
SKETCH_BITS = 12
#: An estimate further from the threshold than this share of it, over six standard errors, settles a line.
BAND = 0.1

BLANKS = " \t\r"


def line_key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Per line that isn't blank: _id, _site, _pos and the two halves of its hash."""
    at = docs.select(F.col(id_col).alias("_id"), F.col(site_col).alias("_site"), F.posexplode(F.split(text_col, "\n")).alias("_pos", "_raw"))
    at = at.select("_id", "_site", "_pos", line_key(F.col("_raw")).alias("_line")).where("_line <> ''")
    return at.select("_id", "_site", "_pos", F.xxhash64("_line").alias("_hi"), F.xxhash64(F.lit("second half"), "_line").alias("_lo"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (_hi, _lo) of the ``lines`` (as of ``occurrences``, checkpointed) on ``min_sites`` sites or more."""
    lines = lines.where(F.col("_site").isNotNull())
    # Counts and sketches are combined in each task before they meet, however popular a line is.
    sketches = lines.groupBy("_hi", "_lo").agg(F.count(F.lit(1)).alias("_n"), F.hll_sketch_agg("_site", F.lit(SKETCH_BITS)).alias("_sketch")).where(F.col("_n") >= min_sites)
    sketched = checkpoint(sketches.select("_hi", "_lo", F.hll_sketch_estimate("_sketch").alias("_sites")))
    margin = max(1.0, BAND * min_sites)
    clear = sketched.where(F.col("_sites") > min_sites + margin).select("_hi", "_lo")
    near = checkpoint(sketched.where(F.abs(F.col("_sites") - min_sites) <= margin).select("_hi", "_lo"))
    sites = lines.join(few(near), ["_hi", "_lo"], "left_semi").select("_hi", "_lo", "_site").distinct()
    exact = sites.groupBy("_hi", "_lo").count().where(F.col("count") >= min_sites)
    return clear.union(exact.select("_hi", "_lo"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with lines that are on ``min_sites`` sites or more removed from ``text_col``, but for one occurrence.

    Lines end at line feeds; they are the same when equal without blanks, tabs and carriage
    returns at their ends; empty lines stay. The occurrence with the smallest (id, position)
    stays, so a text that all sites carry is still there once. ``n_lines`` and
    ``n_removed`` are added (columns of these names are replaced). A null site is none; a
    null text stays null, with no lines. Ids should be unique: rows that repeat an id lose
    the same positions. Documents stay even if all their lines go, with an empty text. An
    empty table gives an empty result; other columns stay as they are.
    """
    docs = docs.drop("n_lines", "n_removed")
    every = checkpoint(occurrences(docs, id_col, text_col, site_col))
    spread = checkpoint(spread_lines(every, min_sites))
    places = checkpoint(every.join(few(spread), ["_hi", "_lo"], "left_semi").select("_hi", "_lo", "_id", "_pos"))
    first = checkpoint(places.groupBy("_hi", "_lo").agg(F.min(F.struct("_id", "_pos")).alias("_first")))
    surplus = places.join(few(first), ["_hi", "_lo"]).where(~F.struct("_id", "_pos").eqNullSafe(F.col("_first")))
    own, key, cut = fresh("_gone", docs), fresh("_key", docs), fresh("_lines", docs)
    gone = surplus.groupBy(F.col("_id").alias(key)).agg(F.collect_set("_pos").alias(own))

    # A text is split once, to a column: inside the lambda it would be split for each line.
    joined = docs.join(gone, F.col(id_col) == F.col(key), "left").withColumn(cut, F.split(text_col, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(own))
    cleaned = F.array_join(F.transform(stay, lambda i: F.get(F.col(cut), i)), "\n")
    return joined.withColumns(
        {
            text_col: F.when(F.col(own).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(cleaned),
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(cut)).cast("long"),
            "n_removed": F.when(F.col(own).isNull(), 0).otherwise(F.size(own)).cast("long"),
        }
    ).select(*docs.columns, "n_lines", "n_removed")
