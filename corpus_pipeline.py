"""A corpus in four stages: toxicity, line dedup, near-dedup, packing.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes what a stage returns as
Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm import line_dedup, near_dedup, packing, toxicity
from lectorium.llm.common import checkpoint, few, own_checkpoints, remove, shared_folder, table
from lectorium.llm.queries import vocabulary

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC``, by a model fitted on them and the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(True)  # so that the text goes to the workers once
    scored = toxicity.score(docs.select("doc_id", "text", packed.alias("others")), model, keep=("others",), with_text=True)
    kept = scored.where(F.col("score") < TOXIC)
    return kept.select(*[F.col("others")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are on many sites, but for one occurrence; ``n_chars`` follows the text."""
    cleaned = line_dedup.line_dedup(docs).drop("n_lines", "n_removed")
    if "n_chars" in cleaned.columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    surplus = checkpoint(near_dedup.near_dedup(docs).where("not kept").select("doc_id"))
    return docs.join(few(surplus), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.packed_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("packing", pack)]

#: Toxicity and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of what a stage needs only its result is kept, and that until the next one
    is written; the last result stays, as it is what is returned."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with own_checkpoints(spark, f"{folder}/checkpoints-{name}"):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
