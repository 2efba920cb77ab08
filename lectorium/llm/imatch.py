"""Document fingerprints: I-Match over randomised subsets of a lexicon.

The lexicon is the terms within a band of inverse document frequency over all documents.
Frequencies are counted for each 64-bit term id. The ids of the lexicon are sent to every
task, 8 bytes a term: as each is in ``LEAST_SHARE`` of the documents, there can't be more
of them than the mean number of a document's distinct terms divided by that share,
however large the corpus. A document's distinct terms of the lexicon are sorted and hashed
once for each of several random subsets of the lexicon.

Subsets come in sizes that halve from level to level; a document uses the levels at which
a subset holds about one of its terms, so that long and short documents can be compared.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table_partitions, tidy
from .near_dedup import mix

#: Distinct terms that a task counts before it puts them out.
COUNTED_TOGETHER = 1_000_000
#: The band: terms in at least this share of the documents and this many of them, and at most in that share.
LEAST_SHARE = 1e-4
LEAST_DOCUMENTS = 2
MOST_SHARE = 0.1
SUBSETS = 48
#: Documents that a task compares, on average, where the session's partitions are fewer.
RANGED_TOGETHER = 2_000

#: ASCII signs part words as white space does.
SIGNS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_FACTORS = np.random.default_rng(5).integers(1, 2**63, SUBSETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class TermIds(dict):
    """64-bit ids of terms; forgets them when there are too many."""

    def __missing__(self, term: bytes) -> int:
        self[term] = value = xxhash.xxh64_intdigest(term, seed=5)
        return value


def terms(text: str, ids: TermIds) -> np.ndarray:
    """Sorted distinct 64-bit ids of the lower-case words of a text."""
    words = text.lower().encode().translate(SIGNS).split()
    if len(ids) > 300_000:
        ids.clear()
    return np.unique(np.fromiter(map(ids.__getitem__, words), np.uint64, len(words)))


class Lexicon:
    """A set of terms by their sorted ids."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Those of the ids that are in the lexicon."""
        if not len(self.ids):
            return ids[:0]
        return ids[self.ids[np.searchsorted(self.ids, ids).clip(max=len(self.ids) - 1)] == ids]


def lexicon(docs: DataFrame, text_col: str = "text", least: int = LEAST_DOCUMENTS, most: float = MOST_SHARE, least_share: float = LEAST_SHARE) -> Lexicon:
    """The terms within the band; counts are exact and cover all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds()
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        waiting = 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            own, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (known[:0], counts[:0])
            both, at = np.unique(np.concatenate([known, own]), return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            sums[at[: len(known)]] = counts
            sums[at[len(known) :]] += n
            return both, sums

        def put(known: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(known), 100_000):
                yield pa.record_batch([pa.array(known[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                fresh.append(terms(text.as_py() or "", ids))
                waiting += len(fresh[-1])
                if waiting > COUNTED_TOGETHER:
                    known, counts = counted()
                    fresh, waiting = [], 0
                    if len(known) > COUNTED_TOGETHER:
                        yield from put(known, counts)
                        known, counts = known[:0], counts[:0]
        yield from put(*counted())

    total = docs.count()
    counted = docs.select(text_col).mapInArrow(tidy(work), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    floor = max(float(least), least_share * total)
    inside = counted.where((F.col("n") >= floor) & (F.col("n") <= max(floor, most * total))).select("term")
    found = inside.toArrow().column("term").to_numpy()
    return Lexicon(np.sort(found.view(np.uint64)))


@dataclass
class Fingerprint:
    """Hashes of the subsets of three levels, 0 for an empty one; no levels without words."""

    level: int
    hashes: np.ndarray

    def __str__(self) -> str:
        return f"{self.level}:{self.hashes.astype('>u2').tobytes().hex()}" if self.level >= 0 else "-"


def fingerprint(text: str, inside: Lexicon, ids: TermIds) -> Fingerprint:
    """The fingerprint of a text; one without any term of the lexicon is fingerprinted by all its terms."""
    own = terms(text, ids)
    kept = inside.of(own)
    if not len(kept):
        kept = own
    if not len(kept):
        return Fingerprint(-1, np.zeros((3, SUBSETS), np.uint64))
    level = len(kept).bit_length() - 1
    sums = np.zeros(3 * SUBSETS, np.uint64)
    for i in range(0, len(kept), 8192):
        part = mix(kept[i : i + 8192])
        place = part[:, None] * _FACTORS[None, :]
        term, subset = np.nonzero(place < np.uint64(1 << (64 - level))) if level else np.nonzero(np.ones(place.shape, bool))
        chosen, value = place[term, subset], mix(part[term])
        once, twice = chosen < np.uint64(1 << (63 - level)), chosen < np.uint64(1 << (62 - level))
        np.add.at(sums, np.concatenate([subset, SUBSETS + subset[once], 2 * SUBSETS + subset[twice]]), np.concatenate([value, value[once], value[twice]]))
    return Fingerprint(level, ((mix(sums) % np.uint64(2**16 - 1) + np.uint64(1)) * (sums != 0)).reshape(3, SUBSETS))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """The share of equal hashes among the subsets in which either text has a term, over the levels that both have."""
    if a.level < 0 or b.level < 0:
        return float(a.level == b.level)
    apart = b.level - a.level
    if abs(apart) > 2:
        return 0.0
    x = a.hashes[max(0, apart) : 3 + min(0, apart)]
    y = b.hashes[max(0, -apart) : 3 + min(0, -apart)]
    used = np.count_nonzero(x | y)
    return np.count_nonzero((x == y) & (x != 0)) / used if used else float(a.level == b.level and np.array_equal(a.hashes, b.hashes))


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by as many first characters of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, inside: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and ``fingerprint``; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(inside.ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = Lexicon(shared.value), TermIds()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([str(fingerprint(t.as_py() or "", table, ids)) for t in batch.column(1)])], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), text_col)
    return rows.mapInArrow(tidy(work), f"id {rows.schema[0].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """``docs`` dealt so that each partition (``_range``) holds one range of ids, in descending order.

    A range is followed by copies (``_guest``) of the rows with the greatest id of the range
    below, or of all for the lowest one. Ranges are those of a range partitioning of the ids
    alone; only the greatest id of each comes to the driver, 8 bytes for some
    ``RANGED_TOGETHER`` rows. All rows of one id are in one range.
    """
    n = partitions or max(table_partitions(docs), docs.count() // RANGED_TOGETHER)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"))
    found = ids.repartitionByRange(n, "_id").groupBy(F.spark_partition_id()).agg(F.max("_id").alias("top"))
    tops = np.sort(found.select("top").toArrow().column("top").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(tops)

    @F.pandas_udf("_range: int, _top: boolean")
    def place(x: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(shared.value, x.to_numpy())
        return pd.DataFrame({"_range": at.astype(np.int32), "_top": shared.value[at] == x.to_numpy()})

    own = F.struct(F.col("_place._range").alias("_range"), F.lit(False).alias("_guest"))
    above = F.struct(((F.col("_place._range") + 1) % max(1, len(tops))).alias("_range"), F.lit(True).alias("_guest"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    placed = rows.withColumn("_place", place("_id"))
    dealt = placed.select("_id", "_text", F.explode(F.when(F.col("_place._top"), F.array(own, above)).otherwise(F.array(own))).alias("_at")).select("_id", "_text", "_at.*")
    return dealt.repartitionById(max(1, len(tops)), "_range").sortWithinPartitions("_guest", F.desc("_id"), "_text")


def compare_edited(docs: DataFrame, inside: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is the one with the next smaller id, after the last the first; rows
    of one id follow each other in the order of their texts, in one task. Null ids are the
    smallest; a null text counts as empty; a text of any length is used whole. A table of
    one row is its own next. Other columns are not read, whatever their names, and an empty
    table gives an empty result.
    """
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    shared = docs.sparkSession.sparkContext.broadcast(inside.ids)
    dealt = with_next(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = Lexicon(shared.value), TermIds()
        last = None  # range, id, text, fingerprint, whether a guest
        for batch in batches:
            out = []
            for doc, text, part, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text.as_py()
                if guest and (last is None or last[0] != part or last[4]):
                    continue  # only the first guest is anyone's next
                own = fingerprint(text, table, known)
                if last and last[0] == part and not last[4]:
                    changed = edit(last[2], text)
                    other = fingerprint(changed, table, known)
                    out.append((None if last[1] == -(2**63) else last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), str(last[3]), str(other), likeness(last[3], other), likeness(last[3], own)))
                last = (part, doc, text, own, guest)
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return dealt.mapInArrow(tidy(work), schema)
