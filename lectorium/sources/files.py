"""Readers and writers of a library's files, as DataFrames."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.encoding import decode
from ..functions.text import normalize_word
from ..operators.markup import single_member, sniff

SLUG = r"([^/]+)/[^/]*$"


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)


def manifests(spark: SparkSession, root: str, name: str = "book.toml") -> DataFrame:
    """Every manifest below a folder: slug, ``fields`` (text values) and ``error`` of an unreadable one."""

    def parse(raw: bytes) -> dict:
        try:
            return {"fields": {k: str(v) for k, v in tomllib.loads(bytes(raw).decode()).items() if isinstance(v, str | int | float)}, "error": None}
        except (ValueError, UnicodeDecodeError) as e:
            return {"fields": None, "error": str(e)[:200]}

    @F.pandas_udf("struct<fields: map<string, string>, error: string>")
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(c) for c in content], columns=["fields", "error"])

    rows = _files(spark, root, name).select(F.regexp_extract("path", SLUG, 1).alias("slug"), read("content").alias("m"))
    return rows.select("slug", "m.fields", "m.error")


def flat_manifest(text: Column) -> Column:
    """A flat ``key = "value"`` file as a map, without a parser; of a repeated key the last holds."""
    lines = F.regexp_extract_all(text, F.lit(r'(?m)^\s*([A-Za-z_]+)\s*=\s*"([^"\n]*)"\s*$'), F.lit(0))
    key = lambda x: F.regexp_extract(x, r"([A-Za-z_]+)\s*=", 1)
    value = lambda x: F.regexp_extract(x, r'=\s*"([^"\n]*)"', 1)
    last = F.filter(lines, lambda x, i: ~F.exists(F.slice(lines, i + 2, F.size(lines)), lambda y: key(y) == key(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(key(x), value(x))))


def books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.BOOK).option("multiLine", True).json(path)


def headers(spark: SparkSession, root: str, name: str, most: int = 300) -> DataFrame:
    """``source`` and ``duration`` from the first bytes of large JSON files."""
    return _files(spark, root, name).select(F.regexp_extract("path", SLUG, 1).alias("slug"), header(F.col("content"), most).alias("h")).select("slug", "h.*")


def header(content: Column, most: int = 300) -> Column:
    """A struct (source, duration) from the first bytes of a JSON file, without reading the rest."""
    head = F.decode(F.substring(content, 1, most), "UTF-8")
    number = F.regexp_extract(head, r'"duration"\s*:\s*(-?[0-9.]+)', 1).try_cast("double")
    return F.struct(F.nullif(F.regexp_extract(head, r'"source"\s*:\s*"([^"]*)"', 1), F.lit("")).alias("source"), number.alias("duration"))


def device_states(spark: SparkSession, root: str) -> DataFrame:
    """One row per device file (32 hexadecimal digits): slug, device, ``state`` as VARIANT, whether it was readable.

    Copies that a sync service leaves under other names are no devices.
    """
    rows = _files(spark, root, "*.json").where(F.col("path").rlike(r"/[0-9a-f]{32}\.json$"))
    state = F.try_parse_json(F.decode("content", "UTF-8"))
    return rows.select(
        F.regexp_extract("path", r"([^/]+)/state/[^/]*$", 1).alias("slug"), F.regexp_extract("path", r"([0-9a-f]{32})\.json$", 1).alias("device"), state.alias("state"), state.isNotNull().alias("readable")
    )


def last_good(states: DataFrame, before: DataFrame) -> DataFrame:
    """Device states as they are, but of an unreadable file what was read of it before; one that never was readable stays so.

    ``before`` is what this gave last time: slug, device, state, readable.
    """
    kept = before.where("readable").select("slug", "device", F.col("state").alias("_before"))
    known = states.join(kept, ["slug", "device"], "left")
    state = F.when(F.col("readable"), F.col("state")).otherwise(F.col("_before"))
    return known.select("slug", "device", state.alias("state"), (F.col("readable") | F.col("_before").isNotNull()).alias("readable"), (~F.col("readable")).alias("stale"))


def variant_number(state: Column, path: str) -> Column:
    """A number of a VARIANT; booleans and numeric strings are none."""
    kind = F.schema_of_variant(F.try_variant_get(state, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(state, path, "double"))


def state_rows(states: DataFrame) -> DataFrame:
    """Device states in long form: slug, device, key, value (as JSON), at_ms; only keys that are there, null values too."""
    entries = [
        F.struct(F.lit(k).alias("key"), F.to_json(F.try_variant_get("state", f"$.{k}", "variant")).alias("value"), F.coalesce(variant_number(F.col("state"), f"$.{k}At"), F.lit(0.0)).alias("at_ms"))
        for k in schema.STATE_KEYS
    ]
    present = F.from_json(F.to_json("state"), "map<string, string>")
    rows = states.where("readable").withColumn("_has", F.map_keys(present)).select("slug", "device", "_has", F.explode(F.array(*entries)).alias("e"))
    return rows.where(F.array_contains("_has", F.col("e.key"))).select("slug", "device", "e.*")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Plain texts of any encoding."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", decode(F.col("content")).alias("text"))


def formats(files: DataFrame) -> DataFrame:
    """``path`` and ``kind`` of files (path, content), archives of one file unwrapped."""

    @F.pandas_udf("string")
    def kind(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([sniff(single_member(bytes(c)), p) for p, c in zip(path, content)])

    return files.select("path", kind("path", "content").alias("kind"))


def captions(df: DataFrame, by: list[str]) -> DataFrame:
    """Words of caption events with their times: a word ends where the next begins, two seconds later at most, the last after half a second."""
    from pyspark.sql import Window

    segs = df.select(*by, F.posexplode("events").alias("_e", "ev")).select(*by, "_e", F.coalesce("ev.tStartMs", F.lit(0)).alias("_t"), F.posexplode("ev.segs").alias("_s", "seg"))
    tokens = segs.select(*by, "_e", "_s", ((F.col("_t") + F.coalesce("seg.tOffsetMs", F.lit(0))) / 1000.0).alias("t0"), F.posexplode(F.split(F.trim(F.coalesce("seg.utf8", F.lit(""))), r"\s+")).alias("_k", "_w"))
    said = tokens.select(*by, "_e", "_s", "_k", "t0", normalize_word(F.col("_w")).alias("word")).where("word <> ''")
    w = Window.partitionBy(*by).orderBy("_e", "_s", "_k")
    end = F.least(F.coalesce(F.lead("t0").over(w), F.col("t0") + 0.5), F.col("t0") + 2.0)
    return said.select(*by, (F.row_number().over(w) - 1).alias("pos"), "word", "t0", end.alias("t1"))


def caption_events(words: DataFrame, by: list[str], segment: str) -> DataFrame:
    """Timed words (word, t0) as caption events, one for each segment: what ``captions`` reads."""
    ms = lambda c: F.floor(c * 1000 + 0.5).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("t0", "word")))
    events = words.groupBy(*by, segment).agg(ordered.alias("_w")).withColumn("_t", ms(F.get("_w", F.lit(0))["t0"]))
    segs = F.transform("_w", lambda w, k: F.struct(F.when(k == 0, w["word"]).otherwise(F.concat(F.lit(" "), w["word"])).alias("utf8"), (ms(w["t0"]) - F.col("_t")).alias("tOffsetMs")))
    event = events.select(*by, segment, F.struct(F.col("_t").alias("tStartMs"), segs.alias("segs")).alias("_e"))
    track = F.array_sort(F.collect_list(F.struct(segment, "_e")))
    return event.groupBy(*by).agg(F.transform(track, lambda x: x["_e"]).alias("events"))


def plain_text(markup: Column) -> Column:
    """Markup as text: tags dropped, the five XML entities decoded, white space even."""
    t = F.regexp_replace(markup, r"(?s)<[^>]*>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def book_json(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with their keys in this order; empty strings and arrays are left out."""
    kept = [F.when(F.size(c) > 0, F.col(c)).alias(c) if df.schema[c].dataType.typeName() == "array" else F.nullif(F.col(c), F.lit("")).alias(c) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in columns]
    return df.select(*keep, F.to_json(F.struct(*kept)).alias("value"))


def toml_string(text: Column) -> Column:
    """A string as TOML writes it."""
    t = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        t = F.replace(t, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), F.regexp_replace(t, r"[\x00-\x1f\x7f]", ""), F.lit('"'))


def land(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a table, or only the partitions that ``df`` has; a reader sees the old files or the new ones."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


#: The parts of a book in the order in which they are landed; a reader goes by the last one.
LANDING = ("editions", "timing", "pictures", "book", "stamp")


def land_book(parts: dict[str, DataFrame], root: str, slug: str, edition: str) -> None:
    """Land a book's parts, each as ``root/part/slug=…/edition=…``, the stamp that names the edition last.

    Until the stamp is there, readers (``landed``) see the edition before; an interrupted run
    leaves nothing that they see, and running it again is harmless. Parts of other names are refused.
    """
    unknown = parts.keys() - set(LANDING[:-1])
    if unknown:
        raise ValueError(f"no parts of a book: {sorted(unknown)}")
    for name in (n for n in LANDING if n in parts):
        parts[name].write.mode("overwrite").parquet(f"{root}/{name}/slug={slug}/edition={edition}")
    spark = next(iter(parts.values())).sparkSession
    stamp = spark.range(1).select(F.lit(edition).alias("current"), F.current_timestamp().alias("landed_at"))
    stamp.coalesce(1).write.mode("overwrite").parquet(f"{root}/stamp/slug={slug}")


def landed(spark: SparkSession, root: str, part: str) -> DataFrame:
    """Rows of one part of all books, of the editions that the stamps name."""
    stamps = spark.read.parquet(f"{root}/stamp").select("slug", F.col("current").alias("edition"))
    return spark.read.option("basePath", f"{root}/{part}").parquet(f"{root}/{part}").join(stamps, ["slug", "edition"])


def safe_name(name: Column) -> Column:
    """The last part of an untrusted path, without what a file name can't hold; ``file`` if nothing is left."""
    last = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(last, r"[^\p{L}\p{N}_.\- ]", "_"), r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit("file"))
