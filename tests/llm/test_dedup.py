"""Exact, line and near-duplicate operators against brute force."""

import hashlib
import random
import time
import timeit

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectorium.llm import exact_dedup, line_dedup, near_dedup
from lectorium.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _set string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), True, "x") for i, t, s in rows], DOCS).repartition(3)


WHITE = " \t\n\x0b\x0c\r"


def brute_exact(rows):
    groups = {}
    for i, t, _ in rows:
        norm = "".join(c for c in t or "" if c not in WHITE)
        groups.setdefault(norm, []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


EXACT = [(1, "a b", "s"), (2, "ab", "s"), (3, "a  b", "s"), (4, "a b", "s"), (5, None, "s"), (6, "", None), (7, " \n\t\x0b\x0c\r", "s"), (8, "ab ", "s"), (9, "é b", "s"), (None, "ab", "s"), (2, "ab", "s"), (11, "z" * 200_000, "s"), (12, "z" * 200_000, "s")]


def test_exact_dedup(spark):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, EXACT)).collect()), key=str)
    assert got == brute_exact(EXACT)


def test_exact_dedup_with_colliding_hashes(spark):
    few_bits = lambda t: (F.length(t).cast("long") % 2, F.lit(0).cast("long"))
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, EXACT), hashes=few_bits).collect()), key=str)
    assert got == brute_exact(EXACT)


def test_exact_dedup_of_very_long_texts(spark):
    rows = [(1, "long text " * 300_000, "s"), (2, "longtext" * 300_000, "s"), (3, "long text " * 300_000 + "!", "s")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs_of(spark, rows).withColumn("group_size", F.lit("clash"))).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True)}


def brute_lines(rows, min_sites):
    sites, first = {}, {}
    lines = [(i, k, line, line.strip(" \t\r"), s) for i, t, s in rows if t is not None for k, line in enumerate(t.split("\n"))]
    for i, k, _, key, s in lines:
        if key and s is not None:
            sites.setdefault(key, set()).add(s)
        if key:
            first[key] = min(first.get(key, (i, k)), (i, k))
    gone = {(i, k) for i, k, _, key, s in lines if len(sites.get(key, ())) >= min_sites and first[key] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t, _ in rows}


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = ["share this", " share this \r", "login", "", "the end", "rare"]
    rows = [(i, "\n".join([*rng.choices(pool, k=rng.randrange(6)), f"own {i}"]), f"s{rng.randrange(5)}" if rng.random() < 0.9 else None) for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, "share this", "s2"), (103, "\n\n", "s3"), (104, "word " * 50_000 + "\nshare this", "s4")]
    for least in (2, 3, 5, 6):
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, rows).withColumn("n_lines", F.lit("x")).withColumn("_gone", F.lit(1)), min_sites=least).collect()}
        assert got == brute_lines(rows, least)


def test_line_dedup_counts_many_sites(spark):
    rows = [(i, f"everywhere\nodd {i % 2}\nline {i % 11} of eleven", f"s{i % 40}") for i in range(440)]
    for least in (10, 20, 40, 41):
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, rows), min_sites=least).collect()}
        assert got == brute_lines(rows, least)


def test_line_dedup_of_documents_with_many_lines(spark):
    """A hundred thousand lines in one document; were it quadratic, this would take most of an hour."""
    many = "\n".join(f"shared {k}" if k % 2 else f"own {k}" for k in range(100_000))
    rows = [(i, f"x {i}\n" + many if i < 2 else many[: 2_000 * i], f"s{i}") for i in range(4)]
    docs = docs_of(spark, rows).withColumn("_lines", F.lit(1)).withColumn("_key", F.lit(2))
    began = time.time()
    got = {r.doc_id: (r.text, r["_lines"], r["_key"]) for r in line_dedup.line_dedup(docs, min_sites=2).collect()}
    assert time.time() - began < 120
    assert got == {i: (t, 1, 2) for i, t in brute_lines(rows, 2).items()}


def brute_near(rows, percent=75):
    sets = {}
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near_rows(seed, n=40, copies=6):
    rng = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 160))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            words = list(base)
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append("  ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    rng.shuffle(rows)
    rows += [None, "", " \n", "one", "ONE", "one two three four", "one\ttwo three four", "É a b c d", "é a b c d"]
    return [(i * 3, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rows = near_rows(seed)
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs_of(spark, rows)).collect())
    assert got == brute_near(rows)


def test_near_dedup_in_small_blocks(spark, monkeypatch):
    """A large family with a shared passage, compared in blocks of a few sets."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(60):
        words = passage + [f"q{k if rng.random() < 0.93 else rng.randrange(10**6)}" for k in range(60)]
        rows.append((i, " ".join(words), "s"))
    rows += [(100 + i, " ".join(passage + [f"u{i}_{k}" for k in range(10)]), "s") for i in range(40)]
    monkeypatch.setattr(near_dedup._dealt, "__defaults__", (8,))
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs_of(spark, rows)).collect())
    assert got == brute_near(rows)


def test_near_dedup_of_long_postings(spark, monkeypatch):
    """A template that many documents fill in, some of them alike, posted anew under rare shingles."""
    rng = random.Random(13)
    template = [f"t{k}" for k in range(70)]
    rows = []
    for i in range(90):
        own = [f"o{i // 3}_{k if rng.random() < 0.9 else rng.randrange(10**6)}" for k in range(40)]
        rows.append((i, " ".join(template + own), "s"))
    monkeypatch.setattr(near_dedup, "LONG", 5)
    met = []
    plain = near_dedup.rare_postings
    monkeypatch.setattr(near_dedup, "rare_postings", lambda *a: met.append(plain(*a)) or met[-1])
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs_of(spark, rows)).collect())
    assert got == brute_near(rows) and len({c for _, _, c, _ in got}) > 25
    assert met  # and in these postings only few meet
    assert not met or met[0].groupBy("_key").count().agg(F.max("count")).first()[0] in (None, 2, 3)


def test_pairs_at_the_limit_are_found(spark):
    """Of pairs at a similarity of 0.75 or little more none of a thousand is missed."""
    rng = random.Random(14)
    rows = []
    for i in range(1000):
        words = [f"v{rng.randrange(10**7)}" for _ in range(124)]
        other = words[:-17] + [f"x{rng.randrange(10**7)}" for _ in range(17)]  # 103 of 137 shingles are shared
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(other), "s")]
    got = near_dedup.near_dedup(docs_of(spark, rows))
    assert {r.component_id for r in got.collect()} == {2 * i for i in range(1000)}


def test_near_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, None, "s")]
    got = sorted((tuple(r) for r in near_dedup.near_dedup(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True)], key=str)


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(5, 5), (500, 499), (499, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    assert got == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert near_dedup.near_dedup(empty).count() == 0


def test_shingles_of_a_column_are_those_of_its_texts_and_take_little_more_than_the_words():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbZ \t\n\x0b\x0c\r\x00\x85\xa0\x1cй.") for _ in range(rng.randint(0, 60))).encode() for _ in range(3000)]
    texts += [b"", b"x" * 300 + b" " + b"y " * 5, b" a b c d e A B c d e f", b"q w e r t " * 60_000]

    def brute(text: bytes) -> frozenset:
        words = text.lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()

    column = pa.array(texts, pa.binary())
    found = list(near_dedup.column_shingles(column))
    for text, hashes in zip(texts, found):
        assert len(hashes) == len(brute(text)) and (np.diff(hashes.astype(object)) > 0).all()
    assert len({h.tobytes() for h in found}) == len({brute(t) for t in texts})
    assert len({int(x) for h in found for x in h}) == len({s for t in texts for s in brute(t)})
    for kind in (pa.binary(), pa.large_binary()):
        assert all((x == y).all() for x, y in zip(near_dedup.column_shingles(column.cast(kind).slice(9, 500)), found[9:509]))

    many = [" ".join(rng.choices([f"w{k}" for k in range(50_000)], k=500)).encode() for _ in range(1000)]
    split = min(timeit.repeat(lambda: [t.lower().split() for t in many], number=1, repeat=3))
    assert min(timeit.repeat(lambda: list(near_dedup.column_shingles(pa.array(many, pa.binary()))), number=1, repeat=3)) < 12 * split
