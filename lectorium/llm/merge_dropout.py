"""SentencePiece BPE with seeded merge-dropout, and its decoding.

A text is cut into chunks that no piece of the model crosses: runs of spaces with what
follows them. In a chunk the best candidate merge is taken from the agenda again and
again (the greatest score, then the leftmost). A candidate is skipped when the hash of
the key, the chunk, its place and its piece falls below the dropout rate; a skipped
candidate stays skipped, so the outcome depends on the key alone. Each occurrence has a
64-bit key of its own, from seed, document and position, so equal words are cut in
different ways. Only the cut without skips is kept for each chunk: it holds for an
occurrence that skips none of the merges made in it, as a candidate that is never taken
changes nothing. All others are cut anew.

Spaces become the model's space sign; a space sign in the text, and characters without a
piece, become byte pieces. So every text is decoded to itself.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .near_dedup import mix

DROPOUT = 0.1
SIGN = "▁"
#: Chunks up to this many symbols are merged side by side in arrays, longer ones with a heap.
SIDE_BY_SIDE = 40
_NONE = np.int64(2**62)


class Codes(dict):
    """Numbers of the chunks; a new one is noted as missing."""

    def __init__(self, missing: list[str]):
        super().__init__()
        self.missing = missing

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.missing.append(chunk)
        return code


class Grown:
    """An array that grows at its end, with room to spare."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + 2 * len(values), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.held[at]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers from ``first`` on, ``n`` of them, one range after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class MergeDropout:
    """An encoder and decoder from a SentencePiece BPE model file with byte pieces."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = 1):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed = dropout, seed
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [b""] * size
        self.byte_id = [0] * 256
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.bytes_of[i] = piece.replace(SIGN, " ").encode()
        self.scores = {i: model.get_score(i) for i in self.ids.values()}
        by_score = sorted(self.scores, key=lambda i: (-self.scores[i], i))
        rank_of = {i: r for r, i in enumerate(by_score)}
        self.breaks = [c for c in "\n\t" if not any(c in p for p in self.ids)]
        crossing = [p for p in self.ids if SIGN in p.lstrip(SIGN)]
        if crossing:
            raise ValueError("pieces of this model cross spaces")
        # Symbols are piece ids, or ``size`` + code point for characters without a piece.
        self.size = size
        merges = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbol(piece[:k], True), self.symbol(piece[k:], True)
                if a is not None and b is not None:
                    merges[a << 21 | b] = rank_of[i] << 21 | i
        self.pairs = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.pairs.tolist()], np.int64)
        self.lookup = merges
        # Letters and a sign that stands after a letter in no piece can't merge either.
        before = {b: False for b in string.punctuation}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if a.isalpha() and b in before:
                    before[b] = True
        signs = re.escape("".join(b for b, met in before.items() if not met))
        ends = "".join(self.breaks)
        self.chunk = re.compile("|".join([*self.breaks, rf" *+[^\W\d_]++(?=[ {ends}{signs}]|\Z)", f" *[^ {ends}]+", " +"]))
        # Symbols of characters by code point, for those below 2 ** 16.
        self.table = np.arange(1 << 16) + size
        for piece, i in self.ids.items():
            if len(piece) == 1 and ord(piece) < 1 << 16:
                self.table[ord(piece)] = i
        self.table[ord(SIGN)] = size + ord(SIGN)
        self.table[ord(" ")] = self.ids.get(SIGN, size + ord(" "))
        self.limit = np.uint64(min(2**64 - 1, int(dropout * 2**64)))
        self.forget()

    def symbol(self, text: str, whole: bool = False) -> int | None:
        if text in self.ids:
            return self.ids[text]
        return self.size + ord(text) if len(text) == 1 else None

    def forget(self) -> None:
        self.missing: list[str] = []
        self.codes = Codes(self.missing)
        # Of each chunk without skips: its ids and the merges made (place << 21 | piece) as ranges; the chunk's hash.
        self.id_start, self.id_count, self.made_start, self.made_count = (Grown(np.int64) for _ in range(4))
        self.hashes = Grown(np.uint64)
        self.flat, self.made = Grown(np.int32), Grown(np.int64)

    def skipped(self, key: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether candidates are skipped: hash of the occurrence's key, the first character's place and the piece."""
        return mix(key + (start.astype(np.uint64) << np.uint64(32)) + piece.astype(np.uint64)) < self.limit

    def hash(self, chunk: str) -> int:
        return xxhash.xxh64_intdigest(chunk, seed=self.seed)

    def key(self, chunk: str, variant: int) -> int:
        return (self.hash(chunk) + variant) % 2**64

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of the characters of a text; a space is the model's sign, the sign itself none of its pieces."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        found = self.table[np.minimum(points, (1 << 16) - 1)]
        for k in np.nonzero(points >= (1 << 16) - 1)[0].tolist():
            found[k] = self.ids.get(chr(points[k]), self.size + int(points[k]))
        return found

    def spell(self, symbols: list[int]) -> list[int]:
        """Ids; characters without a piece become bytes."""
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.size else [self.byte_id[b] for b in chr(s - self.size).encode()]
        return out

    def one(self, chunk: str, variant: int, keyed: bool = False) -> list[int]:
        """The segmentation of one chunk with a heap as agenda, for a variant or, if ``keyed``, a whole key."""
        symbols = self.symbols(chunk).tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        key = np.array([variant if keyed else self.key(chunk, variant)], np.uint64)
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.lookup.get(symbols[i] << 21 | symbols[j])) is not None:
                rank, piece = found >> 21, found & (1 << 21) - 1
                if not self.dropout or not self.skipped(key, np.array([i]), np.array([piece]))[0]:
                    heapq.heappush(agenda, (rank, i, piece, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, piece, a, b = heapq.heappop(agenda)
            if symbols[i] != a or after[i] >= n or symbols[after[i]] != b:
                continue
            j = after[i]
            symbols[i], symbols[j] = piece, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return self.spell([s for s in symbols if s >= 0])

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and piece of pairs of symbols; ``_NONE`` where they don't merge."""
        pair = left << 21 | right
        at = np.searchsorted(self.pairs, pair).clip(max=len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.merged[at], _NONE)

    def many(self, chunks: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations of chunks of similar length, side by side: all ids, and how many each has."""
        return self.side_by_side([c for c, _ in chunks], np.array([self.key(*c) for c in chunks], np.uint64))

    def side_by_side(self, chunks: list[str], keys: np.ndarray | None, made: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As ``many``; without keys nothing is skipped. ``made`` gets the merges as row << 42 | place << 21 | piece."""
        n = len(chunks)
        sizes = np.array([len(c) for c in chunks])
        width = int(sizes.max())
        # Symbols stay where their first character is; column ``width`` stands for both ends.
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[np.arange(width + 1)[None, :] < sizes[:, None]] = self.symbols("".join(chunks))
        after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
        after[:, width] = width

        def candidates(rows: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            found = self.find(left, right)
            hit = np.nonzero(found != _NONE)[0]
            if keys is not None and self.dropout and len(hit):
                drop = self.skipped(keys[rows[hit]], at[hit], found[hit] & (1 << 21) - 1)
                found[hit[drop]] = _NONE
            return found

        agenda = np.full((n, width + 1), _NONE)
        row, at = np.nonzero(symbols[:, 1:] >= 0)
        agenda[row, at] = candidates(row, symbols[row, at], symbols[row, at + 1], at)
        live = np.arange(n)
        while len(live):
            best = agenda[live].argmin(1)
            found = agenda[live, best]
            going = found != _NONE
            live, best, found = live[going], best[going], found[going]
            if not len(live):
                break
            gone, previous = after[live, best], before[live, best]
            following, piece = after[live, gone], found & (1 << 21) - 1
            if made is not None:
                made.append(live << 42 | best << 21 | piece)
            symbols[live, best], symbols[live, gone], agenda[live, gone] = piece, -1, _NONE
            after[live, best], before[live, following] = following, best
            agenda[live, best] = candidates(live, piece, symbols[live, following], best)
            agenda[live, previous] = candidates(live, symbols[live, previous], piece, previous)
        flat, counts = symbols[symbols >= 0], (symbols >= 0).sum(1)
        if (flat >= self.size).any():
            spelled = [self.spell(row[row >= 0].tolist()) for row in symbols]
            flat, counts = np.array([i for x in spelled for i in x], np.int64), np.array([len(x) for x in spelled])
        return flat, counts

    @staticmethod
    def blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Places of chunks of similar length, 2,000 at most."""
        group = (lengths + 2) // 3
        order = np.argsort(group, kind="stable")
        for places in np.split(order, np.nonzero(np.diff(group[order]))[0] + 1):
            for i in range(0, len(places), 2_000):
                yield places[i : i + 2_000]

    def learn(self) -> None:
        """Cut the missing chunks without skips and keep what comes of them; long ones get no ids."""
        n = len(self.missing)
        ids, merges = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
        lengths = np.array([len(c) for c in self.missing])
        short = np.nonzero(lengths <= SIDE_BY_SIDE)[0]
        for places in self.blocks(lengths[short]) if len(short) else ():
            block = short[places]
            made: list[np.ndarray] = []
            flat, counts = self.side_by_side([self.missing[k] for k in block.tolist()], None, made)
            codes = np.sort(np.concatenate(made)) if made else np.zeros(0, np.int64)
            many = np.bincount(codes >> 42, minlength=len(block))
            ids[:, block] = self.flat.n + np.cumsum(counts) - counts, counts
            merges[:, block] = self.made.n + np.cumsum(many) - many, many
            self.flat.extend(flat)
            self.made.extend(codes & (1 << 42) - 1)
        for column, values in ((self.id_start, ids[0]), (self.id_count, ids[1]), (self.made_start, merges[0]), (self.made_count, merges[1])):
            column.extend(values)
        self.hashes.extend(np.array([self.hash(c) for c in self.missing], np.uint64))
        self.missing.clear()

    def skips(self, codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the occurrences that skip a merge made in their chunk without skips."""
        n = self.made_count[codes]
        merge = self.made[ranges(self.made_start[codes], n)]
        on = np.nonzero(self.skipped(np.repeat(keys, n), merge >> 21, merge & (1 << 21) - 1))[0]
        return np.unique(np.searchsorted(np.cumsum(n), on, side="right"))

    def encode_batch(self, documents: list[tuple[int, str]]) -> list[np.ndarray]:
        """Ids of texts, each with the id of its document, on which its keys depend."""
        if len(self.codes) > 400_000:
            self.forget()
        chunks: list[str] = []
        ends, drawn = [], []
        for doc, text in documents:
            found = self.chunk.findall(" " + text) if text else []
            places = np.arange(len(found), dtype=np.uint64)
            drawn.append(mix(places + np.uint64(xxhash.xxh64_intdigest(str(doc), seed=self.seed) >> 1)))
            chunks += found
            ends.append(len(chunks))
        codes = np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))
        if self.missing:
            self.learn()
        keys = self.hashes[codes] + np.concatenate(drawn)
        first, n = self.id_start[codes], self.id_count[codes]
        parts, end = [self.flat.held[: self.flat.n]], self.flat.n
        anew = self.skips(codes, keys) if self.dropout else np.zeros(0, np.int64)
        for places in self.blocks(np.array([len(chunks[k]) for k in anew.tolist()])) if len(anew) else ():
            block = anew[places]
            flat, counts = self.side_by_side([chunks[k] for k in block.tolist()], keys[block])
            first[block], n[block] = end + np.cumsum(counts) - counts, counts
            parts.append(flat)
            end += len(flat)
        for k in np.nonzero(n == 0)[0].tolist():  # long chunks
            ids = self.one(chunks[k], int(keys[k]), keyed=True)
            first[k], n[k] = end, len(ids)
            parts.append(np.array(ids, np.int64))
            end += len(ids)
        flat = np.concatenate([p.astype(np.int32) for p in parts])[ranges(first, n)]
        sizes = np.concatenate([[0], np.cumsum(n)])
        return np.split(flat, sizes[ends[:-1]])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()[1:]


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row its id, columns ``keep`` and ``ids`` (array of int); a null or empty text has none.

    The same seed gives the same ids wherever and whenever a row is encoded, as they depend
    on seed, id and text only; rows that repeat are encoded alike. A null id is an id of its
    own. Texts of any length are encoded whole. Columns that aren't named are not read,
    whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = MergeDropout(model, dropout, seed)
        for batch in batches:
            for part in portions(batch):
                ids = bpe.encode_batch(list(zip(part.column(0).to_pylist(), part.column(part.num_columns - 1).to_pylist())))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "ids"])

    return rows.mapInArrow(tidy(work), _schema(rows) + ", ids array<int>")


def portions(batch: pa.RecordBatch, most: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row its id, columns ``keep`` and ``text``; null ids count as none."""
    rows = encoded.select(F.col(id_col), *keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = MergeDropout(model, 0.0)
        for batch in batches:
            texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(tidy(work), _schema(rows) + ", text string")
