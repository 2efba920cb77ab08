"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, few, squeeze


def content_hash(text: Column) -> tuple[Column, Column]:
    """128 bits in two independent halves."""
    return F.xxhash64(text), F.xxhash64(F.lit("second half"), text)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes=content_hash) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical without white space ``[\\x20\\x09-\\x0D]``; a null text
    counts as empty. Of a group, the row with the most code points in its original text
    stays, then the one with the smallest id. Rows that repeat an id (even the whole row)
    count in ``group_size`` and each gives a row; all rows of the kept id are then kept.
    A null id loses ties against any other. An empty table gives an empty result; other
    columns are not read.

    Rows meet by ``hashes`` of their text. Only texts of groups with more than one row are
    read again: each such group's least and greatest text, combined before the shuffle,
    must be the same bytes, else the text itself joins the key. So a group of any size
    costs each task one row, and a collision splits its group instead of merging texts.
    """
    text = squeeze(F.coalesce(F.col(text_col), F.lit("")))
    spread = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("_len"), text.alias("_text"))
    hi, lo = hashes(F.col("_text"))
    keyed = spread.withColumns({"_hi": hi, "_lo": lo})
    slim = checkpoint(keyed.select("_id", "_len", "_hi", "_lo", F.sha2("_text", 256).alias("text_sha256")))

    shared = checkpoint(slim.groupBy("_hi", "_lo").count().where("count > 1").select("_hi", "_lo"))
    suspects = keyed.join(few(shared), ["_hi", "_lo"], "left_semi")
    clashes = checkpoint(suspects.groupBy("_hi", "_lo").agg(F.min("_text").alias("_a"), F.max("_text").alias("_b")).where("_a <> _b").select("_hi", "_lo"))
    if clashes.isEmpty():
        slim = slim.withColumn("_exact", F.lit(""))
    else:
        # Rows of colliding groups carry their whole text in the key.
        apart = keyed.join(few(clashes.withColumn("_clash", F.lit(True))), ["_hi", "_lo"], "left")
        slim = checkpoint(apart.select("_id", "_len", "_hi", "_lo", F.sha2("_text", 256).alias("text_sha256"), F.when(F.col("_clash"), F.col("_text")).otherwise("").alias("_exact")))

    key = ["_hi", "_lo", "_exact"]
    best = F.min(F.struct(-F.col("_len"), F.col("_id").isNull(), F.col("_id"))).alias("_best")
    groups = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best)
    return slim.join(groups, key).select(
        F.col("_id").alias(id_col),
        F.col("_best")["_id"].alias("keep_id"),
        "group_size",
        F.col("_id").eqNullSafe(F.col("_best")["_id"]).alias("kept"),
        "text_sha256",
    )
