"""Searching catalogues: union, two-key deduplication, editions, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_two_keys(df: DataFrame, block: list[str], order: list[str], link: str, file_key: str) -> DataFrame:
    """Rows, in order, whose link and file key no row kept before them has; a dropped row takes no key.

    A fold over the rows of one block (one search). A null file key is no key.
    """

    def work(pdf):
        pdf = pdf.sort_values(order)
        links, files, keep = set(), set(), []
        for a, b in zip(pdf[link], pdf[file_key]):
            known = b is not None and b == b
            ok = a not in links and not (known and b in files)
            keep.append(ok)
            if ok:
                links.add(a)
                if known:
                    files.add(b)
        return pdf[keep]

    return df.groupBy(*block).applyInPandas(work, df.schema)


def editions(df: DataFrame, key: list[str], volume: Column, order: list[str], part: Column) -> DataFrame:
    """One row per edition: numbered volumes of one key in order, the first row of each number; other rows alone.

    Columns: key, ``first_pos`` (the struct of ``order`` of its first part) and ``parts``.
    """
    numbered = df.withColumns({"_v": volume, "_pos": F.struct(*order), "_part": part})
    w = Window.partitionBy(*key, "_v").orderBy("_pos")
    volumes = numbered.where("_v is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    gathered = volumes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_v", "_pos", "_part"))).alias("_all"))
    many = gathered.select(*key, F.get("_all", F.lit(0))["_pos"].alias("first_pos"), F.transform("_all", lambda x: x["_part"]).alias("parts"))
    single = numbered.where("_v is null").select(*key, F.col("_pos").alias("first_pos"), F.array("_part").alias("parts"))
    return many.union(single)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """The second and further rows of a name get ``-2``, ``-3`` and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat_ws("-", name, n.cast("string"))))


def first_mode(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group; of equals the one seen first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_p"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_p", value)).alias("_b")).select(*by, F.col("_b")[value].alias("mode_value"), (-F.col("_b.n")).alias("n"))


def small_mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group; of equals the smallest."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), value)).alias("_b")).select(*by, F.col("_b")[value].alias("mode_value"), (-F.col("_b.n")).alias("n"))


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Per group the value at place ``n // 2``, from 0, of its n values in order; nulls are none.

    Values are counted before they meet, so a group costs its distinct values and no more.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    return ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias(name))


def judged(hits: DataFrame, by: list[str], related: Column, length: str, expected: Column | None = None, share: float = 0.35) -> DataFrame:
    """Recordings with ``other`` (of another book), ``expected`` length and ``fragment`` (under ``share`` of it).

    What is expected is the book's own length where it is known, else the upper median of the
    related recordings' lengths. Nulls and 0 are no lengths; other books' recordings are no fragments.
    """
    marked = hits.withColumns({"other": ~F.coalesce(related, F.lit(False)), "_length": F.nullif(F.col(length), F.lit(0))})
    middle = upper_median(marked.where("not other"), by, "_length", "_median")
    own = F.nullif(expected, F.lit(0)) if expected is not None else F.lit(None)
    told = marked.join(middle, by, "left").withColumn("expected", F.coalesce(own, F.col("_median")))
    short = ~F.col("other") & (F.col("_length") < F.col("expected") * share)
    return told.withColumn("fragment", F.coalesce(short, F.lit(False))).drop("_length", "_median")


def whole_works(rows: DataFrame, title: str, listing: Column) -> DataFrame:
    """Rows that are whole works: no part of another (a slash in the title) and no list of editions."""
    return rows.where(~F.contains(F.coalesce(title, F.lit("")), F.lit("/")) & ~F.coalesce(listing, F.lit(False)))


def drawn(df: DataFrame, by: list[str], key: list[str], fitting: Column, seed: int) -> DataFrame:
    """One row of each group by a seeded draw: a fitting one if there is any, else any. The draw goes by the key, wherever a row is."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.min_by(row, F.struct(F.when(fitting, 0).otherwise(1), draw))
    return df.groupBy(*by).agg(best.alias("_row")).select("_row.*")
