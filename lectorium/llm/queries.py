"""Queries that apply each operator of this subpackage to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_content, imatch, line_dedup, merge_dropout, near_dedup, packing, sharding, toxicity, url_filter
from .common import checkpoint, table
from .sql import ORACLES

#: Folder of the vocabulary files; ``None`` is where the installed package has them.
VOCABULARIES: str | None = None


def vocabulary(name: str) -> str:
    if VOCABULARIES:
        return f"{VOCABULARIES}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    model = vocabulary("piece_bpe_32k.model")
    encoded = merge_dropout.encode(docs, model, keep=("_sha",))
    counted = encoded.select("doc_id", "_sha", "ids", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))
    decoded = merge_dropout.decode(counted, model, keep=("_sha", "n_tokens", "ids_hash"))
    return decoded.select("doc_id", "n_tokens", "ids_hash", (F.sha2("text", 256) == F.col("_sha")).alias("lossless"))


def op3_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_content.extract_text(pages, html_content.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.compare_edited(docs, imatch.lexicon(docs))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sharding.size_documents(table(spark, sf_dir, "documents"))
    law = {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    return sharding.shard_by_bytes(sized, 24).withColumns(law).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def listed_domains(pages: DataFrame) -> DataFrame:
    """A dated list for the captures of ``pages``, which come without one.

    A quarter of the hosts are added on some day of 2024; half of these are removed again
    after 60 days, and half of those added once more after 90. A sixteenth of the parent
    domains are added on some day too. Days follow from the digits of the name's MD5.
    """
    hosts = pages.select(url_filter.url_host(F.col("url")).alias("name")).where("name is not null").distinct()
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("name"), k, 1)) - 1
    day = F.date_add(F.lit("2024-01-01").cast("date"), digit(2) * 16 + digit(3))
    category = F.when(digit(4) < 8, "spam").otherwise("malware")
    listed = hosts.where(digit(1) < 4)
    removed = listed.where(digit(5) < 8)
    parents = hosts.where(F.size(F.split("name", r"\.")) > 2).select(F.regexp_replace("name", r"^[^.]*\.", "").alias("name")).distinct()
    parts = [
        listed.select(F.col("name").alias("domain"), category.alias("category"), day.alias("effective_on"), F.lit("add").alias("action")),
        removed.select("name", category, F.date_add(day, 60), F.lit("remove")),
        removed.where(digit(6) < 8).select("name", category, F.date_add(day, 90), F.lit("add")),
        parents.where(digit(1) == 4).select("name", F.lit("parent"), day, F.lit("add")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_on"))
    return url_filter.filter_urls(captures, checkpoint(listed_domains(pages)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_merge_dropout, op3_html_content, op4_exact_dedup, op5_imatch, op6_byte_shards, op7_toxicity, op8_url_filter, op9_near_dedup, op10_packing)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLES | own
