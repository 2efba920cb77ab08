"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Rows are put in order of their id by a range partitioning. Each partition's byte and row
totals (one row a partition) are summed up to where the partition begins; a window inside
each partition adds the rest, so no task sees more than its own partition. The axis of
bytes is cut at equal targets; a row belongs to the shard in which its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 8
#: Rows of a partition, where the session's partitions are fewer.
ROWS_TOGETHER = 1_000_000


def shard_by_bytes(sized: DataFrame, shards: int, id_col: str = "doc_id", size_col: str = "size", partitions: int | None = None) -> DataFrame:
    """``sized`` with ``shard`` (0 to ``shards`` - 1), ``slot`` (gapless from 0 in its shard)
    and ``start_byte`` (its place on the axis of all bytes).

    ``sized`` should be narrow: it is checkpointed with its partition numbers, as those may
    change if the range partitioning were run again. Null ids come first; rows with equal
    ids are ordered by size, then by their remaining columns' hash, and rows equal in all
    columns can take each other's place. A null size counts as 0. An empty table gives an
    empty result. Other columns are kept as they are, whatever their names; only columns
    named ``shard``, ``slot`` or ``start_byte`` are replaced. No shard exceeds its equal part by more than one row's size.
    """
    spark = sized.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), sized.count() // ROWS_TOGETHER)
    sized = sized.drop("shard", "slot", "start_byte")
    size, tie, part, rank, begin, every, first, before = (fresh(x, sized) for x in ("_bytes", "_tie", "_part", "_rank", "_begin", "_every", "_first", "_before"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sized.columns])
    rows = sized.withColumns({size: F.coalesce(F.col(size_col).cast("long"), F.lit(0)), tie: hashed})
    ranged = checkpoint(rows.repartitionByRange(n, F.col(id_col), F.col(size), F.col(tie)).withColumn(part, F.spark_partition_id()))

    # One row a partition from here on, whatever the number of rows.
    totals = ranged.groupBy(part).agg(F.sum(size).alias("_b"))
    so_far = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        part,
        F.coalesce(F.sum("_b").over(so_far), F.lit(0)).alias(begin),
        F.sum("_b").over(Window.partitionBy()).alias(every),
    )
    inside = Window.partitionBy(part).orderBy(F.col(id_col), F.col(size), F.col(tie))
    middle = 2 * F.col("start_byte") + F.col(size)
    cut = (
        ranged.join(F.broadcast(starts), part)
        .withColumn("start_byte", F.col(begin) + F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(rank, F.row_number().over(inside).cast("long"))
        .withColumn("shard", F.least(F.floor(middle * shards / F.greatest(2 * F.col(every), F.lit(1))), F.lit(shards - 1)).cast("int"))
    )
    # A shard begins in one partition and goes on in the next ones: where its rows begin in
    # each follows from the counts by partition and shard.
    counts = cut.groupBy(part, "shard").agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias(first))
    earlier = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, "shard", first, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before))
    return (
        cut.join(F.broadcast(offsets), [part, "shard"])
        .withColumn("slot", F.col(before) + F.col(rank) - F.col(first))
        .select(*[F.col(f"`{c}`") for c in sized.columns], "shard", "slot", "start_byte")
    )


def size_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ``size`` (UTF-8 bytes and ``ROW_OVERHEAD``) and ``text_crc32``; a null text has no bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
