"""Near-duplicates by an inverted join on MinHash signature coordinates.

Each distinct shingle set is posted under its coordinate-value pairs. Two sets of a
similarity of 0.75 share 48 of 64 pairs on average; a pair of sets is looked at if it shares
``MATCHES`` or more. Pairs that only one set has cannot count. A set's other pairs are
ordered from the rarest; sharing ``MATCHES`` of them means that one lies in each set's
prefix, which leaves out that many less one of the most frequent. So long postings, as of
a passage that many documents share, are skipped. All links are confirmed on full sets.

Each set is first held against the likest of the smallest sets of its postings and against
those of its longest posting that share the most pairs; what that joins into one component
needs no further look. Only sets of one posting that are still in different components
are then all compared, in blocks, where their full sets are at hand. Where a posting is
long even then, as of a template that many pages fill in, its sets are posted anew under
their rarest shingles, as many as two sets of the asked similarity must share one of. So
sets that share only the template don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_narrow, few, tidy
from .components import connected_components

SHINGLE = 5
PERCENT = 75
COORDINATES = 64
#: Shared coordinates that make a candidate. Of pairs at a similarity of 0.75, 3 in a million share fewer.
MATCHES = 32
#: Sets that a block of the last comparison holds at most, on average.
BLOCK = 800
#: Sets of a posting from which on they are posted anew under their rarest shingles.
LONG = 4 * BLOCK
#: Bytes of texts that are cut into words together.
CHUNK = 1 << 18

_RNG = np.random.default_rng(20)
_STEPS = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_values(place: np.ndarray) -> np.ndarray:
    """Random values of bytes at their places in a word (place * 256 + byte)."""
    return mix((place.astype(np.uint64) + _STEPS[0]) * _FACTORS[0])


_INSIDE, _LOWER = np.ones(256, bool), np.arange(256)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES = byte_values(np.arange(64 * 256))


def column_shingles(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Of each text of a binary column the sorted distinct 64-bit hashes of its shingles of ``size`` words; fewer words are one shingle.

    Bytes know only A-Z as letters and ``[\\x20\\x09-\\x0D]`` as white space. Texts are taken together, some
    ``CHUNK`` bytes at a time: a word's hash is the sum of a random value for each byte at its place in the word.
    """
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.array([], np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        yield from _chunk_shingles(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], size)
        first = last


def _chunk_shingles(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    begins[starts] = inside[starts]  # a text's first word does not go on from the text before
    at = np.flatnonzero(inside)
    heads = np.flatnonzero(begins[at])
    place = (np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))) * 256 + _LOWER[data[at]]
    values = _VALUES[place] if not len(place) or place.max() < len(_VALUES) else byte_values(place)
    codes = np.add.reduceat(values, heads) if len(heads) else np.array([], np.uint64)
    n = max(len(codes) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += mix(codes[i : i + n] + _STEPS[i]) * _STEPS[i]
    total = mix(total)
    words = np.searchsorted(at[heads], ends).tolist()
    for k in range(len(ends) - 1):
        a, b = words[k], words[k + 1]
        if b - a >= size:
            hashes = np.sort(total[a : b - size + 1])
            new = np.ones(len(hashes), bool)
            np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
            yield hashes[new]
        else:
            few_words = data[ends[k] : ends[k + 1]].tobytes().lower().split()
            yield np.array([xxhash.xxh64_intdigest(b" ".join(few_words), seed=b - a)] if few_words else [], np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 coordinate-value pairs as 64-bit keys."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(1), out=least)
    return mix(least ^ _SALTS)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ``n_shingles``, the 128-bit hash of its set (null if empty) and its signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, sigs = [], [], []
            for hashes in column_shingles(batch.column(1)):
                sizes.append(len(hashes))
                sets.append(xxhash.xxh128_digest(hashes.tobytes()) if len(hashes) else None)
                sigs.append(signature(hashes).view(np.int64))
            flat = pa.array(np.concatenate(sigs) if sigs else np.array([], np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), flat)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), lists], names=["_id", "n_shingles", "_set", "_sig"])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(work), "_id long, n_shingles long, _set binary, _sig array<long>")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and its whole set of shingle hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashes.view(np.int64) for hashes in column_shingles(batch.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.array([], np.int64)))
            yield pa.record_batch([batch.column(0), lists], names=["_id", "_shingles"])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(work), "_id long, _shingles array<long>")


def postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The prefix of each class (_rep, _sig) that can have a partner: _rep, _key, the coordinate ``_c``,
    how many classes have the pair (``_n``), and the coordinates of the whole prefix as bits (``_mask``)."""
    posted = classes.select("_rep", F.posexplode("_sig").alias("_c", "_key"))
    common = posted.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    own = posted.join(common, "_key").groupBy("_rep").agg(F.sort_array(F.collect_list(F.struct("_n", "_key", "_c"))).alias("_keys"))
    prefix = own.where(F.size("_keys") >= matches).select("_rep", F.slice("_keys", F.lit(1), F.size("_keys") - matches + 1).alias("_keys"))
    mask = F.aggregate("_keys", F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k["_c"])))
    return prefix.select("_rep", mask.alias("_mask"), F.explode("_keys").alias("_entry")).select("_rep", "_mask", "_entry.*")


def sharing(pairs: DataFrame, shorts: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Of each ``a`` the pair (a, b) that shares the most coordinates, ``matches`` at least, by 15 bits of them (_rep, _short)."""
    left = shorts.select(F.col("_rep").alias("a"), F.col("_short").alias("_sa"))
    right = shorts.select(F.col("_rep").alias("b"), F.col("_short").alias("_sb"))
    same = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x == y), lambda x: x))
    counted = pairs.join(left, "a").join(right, "b").select("a", F.struct(same.alias("n"), "b").alias("_best")).where(F.col("_best.n") >= matches)
    return counted.groupBy("a").agg(F.max("_best").alias("_best")).select("a", "_best.b")


def rare_postings(rows: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Sets (_rep, _component) posted under their rarest shingles, in the form of ``rows``; ``_c`` is -1.

    Two sets that share the percentage share as much of the larger one, so one of the
    shingles that remain when a set is left all but one less than that of its commonest.
    Only postings that span components are returned.
    """
    reps = rows.select("_rep", "_component").distinct()
    each = reps.join(sets.withColumnRenamed("_id", "_rep"), "_rep").select("_rep", "_component", F.explode("_shingles").alias("_key"))
    counts = each.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"))
    own = each.join(counts, "_key").groupBy("_rep", "_component").agg(F.sort_array(F.collect_list(F.struct("_m", "_key"))).alias("_all"))
    many = F.size("_all") - F.ceil(F.size("_all") * percent / 100).cast("int") + 1
    rare = own.select("_rep", "_component", F.explode(F.slice("_all", F.lit(1), many)).alias("_x")).where("_x._m > 1")
    posted = checkpoint_narrow(rare.select("_x._key", F.lit(-1).alias("_c"), "_rep", "_component", F.lit(0).cast("long").alias("_mask")))
    return posted.join(spanning(posted), "_key", "left_semi")


def spanning(placed: DataFrame) -> DataFrame:
    """Keys of postings whose sets are of more than one component."""
    return placed.groupBy("_key").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi")).where("_lo <> _hi").select("_key")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full ``sets`` (_id, _shingles) share the percentage."""
    left = sets.select(F.col("_id").alias("a"), F.col("_shingles").alias("_ha"))
    right = sets.select(F.col("_id").alias("b"), F.col("_shingles").alias("_hb"))
    shared = F.size(F.array_intersect("_ha", "_hb"))
    union = F.size("_ha") + F.size("_hb") - shared
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * union).select("a", "b")


@dataclass
class Block:
    """Sets of one block of a posting: ids, components, prefixes as bits, coordinates, and maybe full sets."""

    rep: np.ndarray
    component: np.ndarray
    mask: np.ndarray
    short: np.ndarray
    shingles: np.ndarray

    def __getitem__(self, rows: np.ndarray) -> Block:
        return Block(self.rep[rows], self.component[rows], self.mask[rows], self.short[rows], self.shingles[rows])


def _counts(x: Block, y: Block, matches: int) -> np.ndarray:
    """How many coordinates each two sets share; 0 where that is too few or they are of one component."""
    if len(x.rep) * len(y.rep) <= 4096:
        counts = (x.short[:, None, :] == y.short[None, :, :]).sum(2, dtype=np.uint8)
    else:
        counts = np.zeros((len(x.rep), len(y.rep)), np.uint8)
        for c in range(COORDINATES):
            counts += x.short[:, c, None] == y.short[None, :, c]
    return np.where((counts >= matches) & (x.component[:, None] != y.component[None, :]), counts, 0)


def _spanning(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A maximum spanning forest of a symmetric matrix of counts, 0 for no edge (Prim)."""
    n = len(counts)
    inside = np.zeros(n, bool)
    best, parent = np.zeros(n, np.int16), np.zeros(n, np.int64)
    edges = []
    for _ in range(n):
        k = int(np.where(inside, -1, best).argmax())
        if best[k] > 0:
            edges.append((k, parent[k]))
        inside[k] = True
        better = (counts[k] > best) & ~inside
        best[better], parent[better] = counts[k][better], k
    return tuple(np.array(edges, np.int64).reshape(-1, 2).T)


def _nearest(x: Block, y: Block, matches: int, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each set of two blocks the ``most`` sets of another component that share the most
    coordinates, and the pairs that join all sets by as many shared coordinates as can be."""
    counts = _counts(x, y, matches)
    a, b = [], []
    for table, own, other in ((counts, x.rep, y.rep), (counts.T, y.rep, x.rep)):
        k = min(most, table.shape[1])
        j = np.argpartition(table, table.shape[1] - k, axis=1)[:, table.shape[1] - k :].ravel()
        i = np.repeat(np.arange(len(table)), k)
        hit = table[i, j] > 0
        a.append(own[i[hit]])
        b.append(other[j[hit]])
    if counts.size > most * most:
        n, m = counts.shape
        whole = np.zeros((n + m, n + m), np.uint8)
        whole[:n, n:], whole[n:, :n] = counts, counts.T
        both = np.concatenate([x.rep, y.rep])
        i, j = _spanning(whole)
        a.append(both[i])
        b.append(both[j])
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _candidates(x: Block, y: Block, place: int, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks that may be linked: of different components, sharing enough.

    Only the first two postings that both prefixes have count, by the bits that are at hand:
    a coordinate that only seems equal may take the place of one. Without a place all count.
    """
    counts = _counts(x, y, matches)
    i, j = np.nonzero(counts)
    if len(i):
        likeliest = np.argsort(-counts[i, j].astype(np.int16), kind="stable")
        i, j = i[likeliest], j[likeliest]
    if len(i) and place >= 0:
        both = x.mask[i] & y.mask[j]
        shared = (x.short[i] == y.short[j]) & (both[:, None] >> np.arange(COORDINATES) & 1).astype(bool)
        early = shared[:, place] & (shared[:, :place].sum(1) < 2)
        i, j = i[early], j[early]
    return i, j


def _links(x: Block, y: Block, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of candidate pairs, those whose full sets share the percentage; a pair that found links already join is passed over."""
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while up.setdefault(k, k) != k:
            k = up[k] = up[up[k]]
        return k

    found = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = top(int(x.component[a])), top(int(y.component[b]))
        if p != q:
            one, two = x.shingles[a], y.shingles[b]
            at = np.searchsorted(one, two).clip(max=len(one) - 1)
            shared = int((one[at] == two).sum())
            if 100 * shared >= percent * (len(one) + len(two) - shared):
                up[p] = q
                found.append((int(x.rep[a]), int(y.rep[b])))
    return found


def _dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (_key, _rep, _component, ...) copied to the pairs of blocks (_i, _j) in which they meet.

    In a posting, a component of more than a block has blocks of its own, which don't meet
    each other; small components share blocks. Blocks are of bounded size on average.
    """
    sizes = rows.groupBy("_key", "_component").agg(F.count(F.lit(1)).alias("_m"))
    small = sizes.where(F.col("_m") <= block).groupBy("_key").agg(F.sum("_m").alias("_smalls"))
    named = rows.join(sizes, ["_key", "_component"]).join(small, "_key", "left")
    large = F.col("_m") > block
    spread = F.when(large, F.col("_rep")).otherwise(F.col("_component"))
    parts = F.ceil(F.when(large, F.col("_m")).otherwise(F.col("_smalls")) / block)
    own = F.struct(F.when(large, F.col("_component")).alias("o"), F.pmod(F.xxhash64(spread), parts).cast("long").alias("k"))
    named = checkpoint_narrow(named.select("_key", "_c", "_rep", "_component", "_mask", own.alias("_own")))
    met = named.join(named.groupBy("_key").agg(F.collect_set("_own").alias("_others")), "_key").withColumn("_other", F.explode("_others"))
    met = met.where(F.col("_own.o").isNull() | ~F.col("_own.o").eqNullSafe(F.col("_other.o")))
    x, y = F.xxhash64(F.col("_own.o"), F.col("_own.k")), F.xxhash64(F.col("_other.o"), F.col("_other.k"))
    return met.select("_key", F.least(x, y).alias("_i"), F.greatest(x, y).alias("_j"), x.alias("_b"), F.col("_c").cast("long").alias("_c"), "_rep", "_component", "_mask")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block, int, np.ndarray]]:
    """The two blocks of each (_key, _i, _j) of sorted rows, its coordinate, and its rows; one batch and one group are held."""
    held: list[np.ndarray] | None = None

    def blocks(a: int, b: int) -> tuple[Block, Block, int, np.ndarray]:
        key, i, j, own, c, rep, component, mask, short, *sets = (z[a:b] for z in held)
        every = Block(rep, component, mask, short, sets[0] if sets else np.zeros(b - a))
        return every[own == i[0]], every[own == j[0]], int(c[0]), np.stack([key, i, j, own, c, rep, component, mask])

    for batch in batches:
        fresh = [batch.column(k).to_numpy() for k in range(8)] + [batch.column(8).flatten().to_numpy().reshape(-1, COORDINATES)]
        if batch.num_columns > 9:
            lists = np.empty(batch.num_rows, object)
            lists[:] = [v.values.to_numpy().view(np.uint64) for v in batch.column(9)]  # ascending only without a sign
            fresh.append(lists)
        held = fresh if held is None else [np.concatenate(z) for z in zip(held, fresh)]
        ends = (np.nonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0))[0] + 1).tolist()
        for a, b in zip([0, *ends], ends):
            if b - a > 1:
                yield blocks(a, b)
        held = [z[ends[-1] :] for z in held] if ends else held
    if held is not None and len(held[0]) > 1:
        yield blocks(0, len(held[0]))


ROWS = ("_key", "_i", "_j", "_b", "_c", "_rep", "_component", "_mask")


def _sorted_groups(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")


def nearest(dealt: DataFrame, shorts: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) of the likest sets of different components, and those that would join all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, _, _ in _groups(batches):
            if len(x.rep) and len(y.rep):
                a, b = _nearest(x, y, matches)
                both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                if both.shape[1]:
                    yield pa.record_batch([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])

    return _sorted_groups(dealt.join(shorts, "_rep").select(*ROWS, "_short")).mapInArrow(tidy(work), "a long, b long")


def settled(dealt: DataFrame, shorts: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links (a, b) that still join components, after comparing all candidates.

    First only the rows that have a candidate are kept; these get their full sets, and each
    group of blocks is settled where it lies. No pair is put out but a link.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, place, rows in _groups(batches):
            if len(x.rep) and len(y.rep):
                i, j = _candidates(x, y, place, matches)
                wanted = rows[:, np.isin(rows[5], np.concatenate([x.rep[i], y.rep[j]]))]
                if wanted.shape[1]:
                    yield pa.record_batch([pa.array(c.astype(np.int64)) for c in wanted], names=list(ROWS))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, place, _ in _groups(batches):
            if len(x.rep) and len(y.rep):
                found = _links(x, y, *_candidates(x, y, place, matches), percent)
                if found:
                    a, b = (pa.array(z, pa.int64()) for z in zip(*found))
                    yield pa.record_batch([a, b], names=["a", "b"])

    kept = _sorted_groups(dealt.join(shorts, "_rep").select(*ROWS, "_short")).mapInArrow(tidy(keep), ", ".join(f"{c} long" for c in ROWS))
    kept = checkpoint_narrow(kept)
    full = kept.join(shorts, "_rep").join(sets.withColumnRenamed("_id", "_rep"), "_rep").select(*ROWS, "_short", "_shingles")
    return _sorted_groups(full).mapInArrow(tidy(settle), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id``, ``kept``.

    A-Z count as a-z, and words are runs of other characters than ``[\\x20\\x09-\\x0D]``. A
    document is the set of its runs of 5 words; fewer words are one shingle; a null, empty
    or blank text has none and is linked with nothing. Documents are linked when 100 times
    the intersection is at least ``percent`` times the union. ``component_id`` is the
    smallest id that links reach; the document with that id is kept. Rows that repeat an id
    each give a row; a null id with words takes part in its class only. An empty table gives
    an empty result; other columns are not read.

    Documents of equal sets form a class at once, whatever their number; only a class's
    smallest id is posted. Signatures, classes and postings are checkpointed.
    """
    slim = checkpoint(signatures(docs, id_col, text_col))
    classes = checkpoint(slim.where(F.col("_set").isNotNull() & F.col("_id").isNotNull()).groupBy("_set").agg(F.min("_id").alias("_rep"), F.first("_sig").alias("_sig")))
    posted = checkpoint_narrow(postings(classes, matches))

    # Only these classes can be linked at all; their full sets are read from the texts.
    wanted = checkpoint_narrow(posted.select(F.col("_rep").alias("_id")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(few(wanted), "_id", "left_semi")
    sets = checkpoint(shingle_sets(texts, "_id", "_text"))
    bits = F.transform("_sig", lambda x: x.bitwiseAND(0x7FFF).cast("smallint"))
    shorts = checkpoint(classes.join(few(wanted), F.col("_rep") == F.col("_id"), "left_semi").select("_rep", bits.alias("_short")))

    # Round 1 also holds every set against the smallest one of each of its postings.
    hubs = posted.groupBy("_key").agg(F.min("_rep").alias("b"))
    hub_pairs = posted.join(hubs, "_key").where("_rep <> b").select(F.col("_rep").alias("a"), "b").distinct()
    links = reached = None
    for last in (False, False, True):
        placed = posted.select("_rep", "_key", "_c", "_mask", "_n")
        if reached is None:
            placed = placed.withColumn("_component", F.col("_rep"))
        else:
            placed = checkpoint_narrow(placed.join(reached, F.col("_rep") == F.col("node"), "left").withColumn("_component", F.coalesce("component", "_rep")).drop("node", "component"))
        rows = placed.join(spanning(placed), "_key", "left_semi")
        if not last:  # each class in its longest posting only; what this joins shrinks the rest
            longest = F.max(F.struct("_n", "_key", "_c", "_mask", "_component")).alias("_best")
            rows = rows.groupBy("_rep").agg(longest).select("_rep", "_best.*")
        else:
            rows = checkpoint_narrow(rows.select("_key", "_c", "_rep", "_component", "_mask"))
            long = checkpoint_narrow(rows.groupBy("_key").count().where(F.col("count") > LONG).select("_key"))
            if not long.isEmpty():
                rare = rare_postings(rows.join(few(long), "_key", "left_semi"), sets, percent)
                rows = rows.join(few(long), "_key", "left_anti").unionByName(rare)
        dealt = _dealt(checkpoint_narrow(rows.select("_key", "_c", "_rep", "_component", "_mask")))
        if last:
            found = settled(dealt, shorts, sets, percent, matches)
        else:
            pairs = nearest(dealt, shorts, matches)
            pairs = pairs.union(sharing(hub_pairs, shorts, matches)) if reached is None else pairs
            found = confirmed(checkpoint_narrow(pairs.distinct()), sets, percent)
        links = checkpoint_narrow(found if links is None else links.union(found))
        reached = connected_components(links)

    named = classes.join(reached, classes["_rep"] == reached["node"], "left").select("_set", F.coalesce("component", "_rep").alias("_component"))
    component = F.coalesce("_component", "_id")
    return slim.join(named, "_set", "left").select(
        F.col("_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
