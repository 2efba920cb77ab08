"""URL filters by dated lists: each capture is judged by the list as it was when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR_FUTURE = "9999-12-31"


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def parent_domains(host: Column) -> Column:
    """The host and its parents of two labels or more, longest first; an address (in brackets, or with a number last) has none."""
    labels = F.split(host, r"\.")
    address = F.startswith(host, F.lit("[")) | host.rlike(r"(^|\.)[0-9]+$")
    starts = F.when(~address & (F.size(labels) >= 2), F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array(F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries (domain, category, effective_on, action) as intervals: domain, category, valid_from, valid_to (open end).

    ``action`` is ``add`` or ``remove``; anything else and entries with a null domain,
    category or date are ignored. Of one day's entries for one domain and category,
    ``remove`` holds. Runs of the same action are one interval; an addition that is never
    removed holds until ``FAR_FUTURE``.
    """
    known = entries.where("domain is not null and category is not null and effective_on is not null and action in ('add', 'remove')")
    # One row a day, combined before the shuffle; 'remove' is the greater of the two words.
    daily = known.groupBy(F.lower("domain").alias("domain"), "category", "effective_on").agg(F.max("action").alias("action"))
    by_entry = Window.partitionBy("domain", "category").orderBy("effective_on")
    changes = daily.withColumn("_before", F.lag("action").over(by_entry)).where("_before is null or _before <> action")
    ends = changes.withColumn("valid_to", F.coalesce(F.lead("effective_on").over(by_entry), F.lit(FAR_FUTURE).cast("date")))
    return ends.where("action = 'add'").select("domain", "category", F.col("effective_on").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """One row per capture: id, URL, day, ``host``, ``blocked``, ``matched_domain``, ``category``, ``listed_on``.

    A capture is blocked when its host or a parent domain was on the list on the day of the
    fetch (from the day of the addition to the day before the removal). The longest domain
    is named, then the smallest category. A URL without a host, a null URL or a null day
    matches nothing. Each row of ``captures`` gives one row, repeated rows too, unless
    rows share an id, URL and day: these are one capture. Empty tables are fine; other
    columns are not read.

    Each (domain, category) has one interval a day at most, so the join gives at most one
    row per capture, parent domain and category. A popular host is split by the join.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(day_col).cast("date").alias("_day"))
    asked = rows.select("_id", "_url", "_day", url_host(F.col("_url")).alias("host"))
    named = asked.where("host is not null and _day is not null").select("_id", "_url", "_day", F.posexplode(parent_domains(F.col("host"))).alias("_depth", "domain"))
    listed = validity_intervals(entries)
    hits = named.join(listed, (named["domain"] == listed["domain"]) & (F.col("_day") >= F.col("valid_from")) & (F.col("_day") < F.col("valid_to")))
    best = hits.groupBy(F.col("_id").alias("_bid"), F.col("_url").alias("_burl"), F.col("_day").alias("_bday")).agg(
        F.min(F.struct("_depth", "category", named["domain"].alias("domain"), F.col("valid_from").alias("since"))).alias("_best")
    )
    same = F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_url") == F.col("_burl")) & (F.col("_day") == F.col("_bday"))
    return asked.join(best, same, "left").select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_day").alias(day_col),
        "host",
        F.col("_best").isNotNull().alias("blocked"),
        F.col("_best")["domain"].alias("matched_domain"),
        F.col("_best")["category"].alias("category"),
        F.col("_best")["since"].alias("listed_on"),
    )
