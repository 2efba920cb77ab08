"""Best-fit packing, planned over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. The driver sees only how many
pieces there are of each length, plans best-fit decreasing over these counts, and writes
the plan as runs: so many pieces of one length, from one rank on, go to consecutive
sequences at one offset. Pieces then find their slots by their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, tidy

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that a task ranks together, on average.
RANKED_TOGETHER = 20_000
#: Runs of a plan that may be broadcast; a plan is some hundred runs to some ten thousand, whatever the corpus.
MOST_RUNS = 500_000

#: Words, or blanks over one a word, from which on a text is not plain.
LONG_RUN = 1_000
#: Signs that are a letter, a mark or a blank to any library: white space, ASCII, Latin, Greek, Cyrillic,
#: Hebrew and Arabic letters, punctuation, kana, Han and Hangul.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*+")

PIECES = "doc_id long, piece int, start long, length long, ids binary"


class ByteBpe:
    """Ids as the ``tokenizers`` library gives them for a JSON file of byte-level BPE, as the file stands.

    Added tokens in a text, such as ``<|endoftext|>``, get their own ids. Plain texts, which
    are nearly all, go through a faster library with the vocabulary of the same file, which
    gives equal ids (tested); texts with an added token, with signs that are not plain, with
    very long words or much white space go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"\Z\A.").search
        bytes_of = byte_letters()
        ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def is_plain(self, text: str) -> bool:
        words = text.split()
        longest, blanks = max(map(len, words), default=0), len(text) - sum(map(len, words))
        return longest < LONG_RUN and blanks - len(words) < LONG_RUN and PLAIN.fullmatch(text) is not None and self.added(text) is None

    def encode(self, text: str) -> np.ndarray:
        if self.is_plain(text):
            return self.fast.encode_to_numpy(text)
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: those that can be seen as such stand for themselves."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(unseen)}


def cut(n: int, capacity: int) -> list[int]:
    """Where pieces of ``n`` tokens begin, ``n`` last: all but the first are full."""
    return [0, *range(n - (n - 1) // capacity * capacity, n, capacity), n]


def encode_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ``piece`` from 0, ``start``, ``length``, ``ids`` (little-endian uint32).

    A document is its tokens, then ``end_id``; a null text is empty, so it gives one piece
    of one token. Only documents longer than ``capacity`` are cut; the first piece then
    takes what is over. Null ids and repeated rows are kept, each on its own. Other columns
    are not read, whatever their names; an empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        bpe = ByteBpe(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = cut(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    out.append((doc, k, a, b - a, ids[a:b].tobytes()))
                held += len(ids)
                if held > 1_000_000:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(encode), PIECES)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, first sequence, offset).

    Sequences that were filled alike stand together as (first, how many), by the room that
    is left; lengths come from the longest down and go where the least room fits.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted keys of room
    sequences = 0

    def add(left: int, first: int, n: int) -> None:
        if left:
            if left not in room:
                insort(rooms, left)
            room.setdefault(left, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                whole, rest = divmod(todo, each)
                for n, filled in ((whole, each), (1 if rest else 0, rest)):
                    for i in range(filled if n else 0):
                        runs.append((length, rank, n, sequences, i * length))
                        rank += n
                    if n:
                        add(capacity - filled * length, sequences, n)
                        sequences += n
                todo = 0
            else:
                left = rooms[k]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[k]
                m = min(n, todo)
                runs.append((length, rank, m, first, capacity - left))
                add(left - length, first, m)
                if n > m:
                    add(left, first + m, n - m)
                rank += m
                todo -= m
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; narrow rows with doc_id, piece and length.

    ``pieces`` is read more than once, so it must be checkpointed or cheap. Every length
    must be from 1 to ``capacity``. Ranks within a length are counted by salted parts, so a
    length that holds most pieces is spread as well, and so are rows that are all alike.
    Columns named ``sequence_id`` or ``offset`` are replaced, others are kept, but those of
    the plan (_length, _first, _n, _sequence, _offset) are dropped. An empty table gives an
    empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "_length", "_first", "_n", "_sequence", "_offset")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row a length
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = plan_runs(counts, capacity)
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "_length long, _first long, _n long, _sequence long, _offset long")
    if len(runs) <= MOST_RUNS:
        plan = F.broadcast(plan)

    # The salt is kept in the checkpoint, so rows equal in all columns can be spread as well.
    salts = max(64, sum(counts.values()) // RANKED_TOGETHER)
    salt, rank_col, base = (fresh(name, pieces) for name in ("_salt", "_rank", "_base"))
    spread = F.pmod(F.xxhash64(*pieces.columns, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(salts))
    salted = checkpoint(pieces.withColumn(salt, spread))
    parts = salted.groupBy("length", salt).count()
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", salt, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy("length", salt).orderBy("doc_id", "piece")
    ranked = salted.withColumn(rank_col, F.row_number().over(inside)).join(bases, ["length", salt]).withColumn(rank_col, F.col(rank_col) - 1 + F.col(base))
    rank, first = F.col(rank_col), F.col("_first")
    return ranked.join(plan, (F.col("length") == F.col("_length")) & (rank >= first) & (rank < first + F.col("_n"))).select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("_sequence") + rank - first).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their places; of the tokens only ``ids_crc32`` stays."""
    pieces = encode_pieces(docs, vocabulary, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"))
    return pack(checkpoint(pieces), capacity)
