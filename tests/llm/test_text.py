"""Tokens, fingerprints, pages, toxicity."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectorium.llm import html_content, imatch, merge_dropout, packing, toxicity
from lectorium.llm.queries import vocabulary

TEXTS = ["", None, " ", "Hello, world", "  two  spaces\n\tand ▁ a sign", "é😀\x00x", "word " * 3000, "a" * 70, "<|endoftext|> <s> </s>", "Ünïcödé ﬁ 中文 текст", "\n\n\n", "x"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(2)


# Merge-dropout


def plain_mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD % 2**64
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
    return x ^ x >> 33



def test_without_dropout_it_is_the_library(spark):
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    own = merge_dropout.MergeDropout(model, 0.0)
    texts = [t for t in TEXTS if t and "▁" not in t]
    for text, ids in zip(texts, own.encode_batch(list(enumerate(texts)))):
        assert ids.tolist() == library.encode(text)


def test_dropout_round_trip_and_keys(spark):
    model = vocabulary("piece_bpe_32k.model")
    docs = docs_of(spark, TEXTS)
    first, again, other = (merge_dropout.encode(docs, model, 0.3, seed) for seed in (1, 1, 2))
    ids = lambda df: {r.doc_id: list(r.ids) for r in df.collect()}
    a, b, c = ids(first), ids(again.repartition(1)), ids(other)
    assert a == b and a != c
    decoded = {r.doc_id: r.text for r in merge_dropout.decode(first, model).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(TEXTS)}


def test_array_and_heap_agree():
    rng = random.Random(1)
    bpe = merge_dropout.MergeDropout(vocabulary("piece_bpe_32k.model"), 0.2)
    chunks = [("".join(rng.choice("▁ abcdeinrst,Éж") for _ in range(rng.randrange(1, 38))), v) for v in range(4) for _ in range(100)]
    flat, counts = bpe.many(chunks)
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == [bpe.one(*c) for c in chunks]


def test_equal_words_vary():
    bpe = merge_dropout.MergeDropout(vocabulary("piece_bpe_32k.model"), 0.5)
    ids = bpe.encode_batch([(1, "international " * 50)])[0].tolist()
    pieces = " ".join(map(str, ids))
    assert len({x for x in pieces.split(str(bpe.ids["▁"]))}) > 1
    assert bpe.decode(np.array(ids)) == "international " * 50


def test_each_occurrence_has_its_own_skips():
    model = vocabulary("piece_bpe_32k.model")
    bpe = merge_dropout.MergeDropout(model, 0.1)
    text = "international " * 4000
    ids = bpe.encode_batch([(1, text)])[0].tolist()
    words, word = [], []
    for i in ids:
        word.append(i)
        if bpe.decode(np.array([bpe.ids["▁"], *word])).strip().endswith("international"):
            words.append(tuple(word))
            word = []
    assert len(words) == 4000 and len(set(words)) > 20  # more than eight ways


def test_kept_cuts_are_those_of_the_heap():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeinrstÉж,") for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["international", "the", "and"]
    docs = [(d, " ".join(rng.choices(words, k=150)) + "\n") for d in range(12)] + [(20, ""), (None, "the " * 30)]
    for rate in (0.1, 0.5, 1.0):
        bpe = merge_dropout.MergeDropout(vocabulary("piece_bpe_32k.model"), rate)
        for (doc, text), got in zip(docs, bpe.encode_batch(docs)):
            chunks = bpe.chunk.findall(" " + text) if text else []
            start = merge_dropout.xxhash.xxh64_intdigest(str(doc), seed=1) >> 1
            keys = merge_dropout.mix(np.arange(len(chunks), dtype=np.uint64) + np.uint64(start)).tolist()
            assert got.tolist() == [i for c, k in zip(chunks, keys) for i in bpe.one(c, k)]


def brute_merges(model, chunk, key, rate):
    """Merge-dropout by the book: look at all pairs, take the best that is not skipped, again and again."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = {library.id_to_piece(i): i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))}
    byte = {int(library.id_to_piece(i)[1:-1], 16): i for i in range(library.get_piece_size()) if library.is_byte(i)}
    signs = [(k, "▁" if c == " " else c, c == "▁") for k, c in enumerate(chunk)]  # place, letters, whether a sign of the text
    limit = min(2**64 - 1, int(rate * 2**64))
    while True:
        best = None
        for n, ((k, a, x), (_, b, y)) in enumerate(zip(signs, signs[1:])):
            i = None if x or y else pieces.get(a + b)
            if i is not None and not plain_mix((key + (k << 32) + i) % 2**64) < limit:
                best = min(best or (0.0 + 1e9, 0, 0, 0), (-library.get_score(i), i, k, n), key=lambda c: (c[0], c[1], c[2]))
        if best is None:
            break
        n = best[3]
        signs[n : n + 2] = [(signs[n][0], signs[n][1] + signs[n + 1][1], False)]
    out = []
    for _, letters, sign in signs:
        out += [pieces[letters]] if letters in pieces and not sign else [byte[b] for b in letters.encode()]
    return out


def test_dropout_against_brute_force():
    model = vocabulary("piece_bpe_32k.model")
    rng = random.Random(17)
    words = ["international", "the", "and", "Ünïcödé", "▁x▁", "a" * 45, "don't,stop!", "中文字"] + ["".join(rng.choice("abcdeinrst,.Éж") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    for rate, seed in ((0.0, 1), (0.1, 1), (0.5, 3), (1.0, 2)):
        bpe = merge_dropout.MergeDropout(model, rate, seed)
        for doc in (7, -3, None):
            text = " ".join(rng.choices(words, k=25)) + "\n  end\t"
            chunks = bpe.chunk.findall(" " + text)
            start = merge_dropout.xxhash.xxh64_intdigest(str(doc), seed=seed) >> 1
            want = [i for k, c in enumerate(chunks) for i in brute_merges(model, c, (merge_dropout.xxhash.xxh64_intdigest(c, seed=seed) + plain_mix(k + start)) % 2**64, rate)]
            assert bpe.encode_batch([(doc, text)])[0].tolist() == want


def test_odd_tables_are_encoded(spark):
    model = vocabulary("piece_bpe_32k.model")
    rows = [(None, "the same words", 1, 2), (None, "the same words", 1, 2), (4, None, 1, 2), (5, "x" * 300_000, 1, 2), (6, " " * 20_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, _text int")
    encoded = merge_dropout.encode(docs, model)
    got = encoded.collect()
    assert encoded.columns == ["doc_id", "ids"] and len({tuple(r.ids) for r in got if r.doc_id is None}) == 1 and len(got) == 5
    assert {r.doc_id: r.text for r in merge_dropout.decode(encoded, model).collect()} == {None: "the same words", 4: "", 5: "x" * 300_000, 6: " " * 20_000}
    assert merge_dropout.encode(docs.limit(0), model).count() == 0 == merge_dropout.decode(encoded.limit(0), model).count()


# Packing


def test_tokens_are_those_of_the_json_file():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    reference, own = Tokenizer.from_file(path), packing.ByteBpe(path)
    rng = random.Random(11)
    signs = ["a", "the", "é", "ж", "中", "😀", "1", "42", ".", "'s", "'ll", "<|endoftext|>", "<|endoftext", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\ufeff", "\x00", "\u0301"]
    made = ["".join(rng.choices(signs, k=rng.randrange(1, 25))) for _ in range(4000)]
    rng = random.Random(12)  # plain texts of all signs
    plain = [chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000 and packing.PLAIN.fullmatch(chr(k))]
    common = [*"\t\n\r    ", *(chr(k) for k in range(33, 127)), "'s", "'re", "'LL"]
    drawn = ["".join(rng.choices(common, k=20) + rng.choices(plain, k=10)) for _ in range(6000)]
    made += ["".join(rng.sample(x, len(x))) for x in drawn] + ["".join(plain[k : k + 50]) for k in range(0, len(plain), 50)]
    specials = ["<|endoftext|> hi <|endoftext|>", "end <|endoftext|> of", "a<|endoftext|>\n\n<|endoftext|> b"]
    for t in [*TEXTS, *made, *specials, " " * 2_000_000, "\n" * 300_000 + "x", "x" * 200_000, " \n" * 100_000 + " y"]:
        assert own.encode(t or "").tolist() == reference.encode(t or "", add_special_tokens=False).ids
    assert own.encode("<|endoftext|>").tolist() == [50256]


def test_tokens_of_the_table_are_those_of_the_json_file(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    reference, own = Tokenizer.from_file(path), packing.ByteBpe(path)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(map(own.is_plain, texts)) > 0.9 * len(texts)
    for i in range(0, len(texts), 200):
        assert [own.encode(x).tolist() for x in texts[i : i + 200]] == [x.ids for x in reference.encode_batch(texts[i : i + 200], add_special_tokens=False)]


def test_odd_packing(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(1, None, 5, "x", 1), (1, None, 5, "x", 1), (None, " " * 1_500_000, 1, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long, _salt string, length long")
    packed = packing.packed_documents(docs, path).collect()
    assert len(packed) == 2 + -(-1_500_001 // 2048) and len({(p.sequence_id, p.offset) for p in packed}) == len(packed)
    assert packing.packed_documents(docs.limit(0), path).count() == 0
    alike = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(100).cast("long").alias("length"), F.lit(1).alias("_salt"), F.lit(2).alias("offset"), F.lit(3).alias("_rank"))
    got = packing.pack(alike).collect()
    assert len({(p.sequence_id, p.offset) for p in got}) == 500 and len({p.sequence_id for p in got}) == 25 and got[0]["_rank"] == 3 and got[0]["_salt"] == 1


def test_cut():
    assert packing.cut(1, 4) == [0, 1] and packing.cut(4, 4) == [0, 4] and packing.cut(5, 4) == [0, 1, 5] and packing.cut(8, 4) == [0, 4, 8] and packing.cut(9, 4) == [0, 1, 5, 9]


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit():
    rng = random.Random(2)
    for capacity in (7, 20, 64):
        for _ in range(60):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 80))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            runs = packing.plan_runs(counts, capacity)
            placed = [(n, s + k, o) for n, _, m, s, o in runs for k in range(m)]
            assert sorted(n for n, *_ in placed) == sorted(lengths)
            fill = {}
            for n, s, o in sorted(placed, key=lambda x: (x[1], x[2])):
                assert fill.get(s, 0) == o
                fill[s] = o + n
            assert all(v <= capacity for v in fill.values()) and len(fill) == best_fit(lengths, capacity)
            for n, c in counts.items():
                ranks = sorted((a, a + m) for k, a, m, *_ in runs if k == n)
                assert ranks[0][0] == 0 and ranks[-1][1] == c and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))


def test_packing_is_a_round_trip(spark):
    texts = [*TEXTS, *[f"text {i % 7} " * (i % 40) for i in range(200)], "long " * 9000]
    docs = docs_of(spark, texts)
    pieces = packing.encode_pieces(docs, vocabulary("byte_bpe_50k.json")).collect()
    bpe = packing.ByteBpe(vocabulary("byte_bpe_50k.json"))
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.piece)):
        ids = np.frombuffer(p.ids, "<u4")
        assert p.start == len(whole.get(p.doc_id, [])) and len(ids) == p.length <= 2048 and (p.length == 2048 or p.piece == 0)
        whole.setdefault(p.doc_id, []).extend(ids.tolist())
    assert {i: bpe.library.decode(x[:-1], skip_special_tokens=False) for i, x in whole.items()} == {i: t or "" for i, t in enumerate(texts)} and all(x[-1] == 0 for x in whole.values())
    packed = packing.packed_documents(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted((p.doc_id, p.piece) for p in packed) == sorted((p.doc_id, p.piece) for p in pieces)
    fill = {}
    for p in sorted(packed, key=lambda p: (p.sequence_id, p.offset)):
        assert fill.get(p.sequence_id, 0) == p.offset
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 2048 and len(fill) == best_fit([p.length for p in packed], 2048)
    repeated = packing.packed_documents(docs.union(docs), vocabulary("byte_bpe_50k.json")).collect()
    assert len({(p.sequence_id, p.offset) for p in repeated}) == len(repeated) == 2 * len(packed)


# Fingerprints


def test_lexicon_counts_documents(spark):
    texts = ["alpha beta", "alpha gamma gamma", "alpha delta beta", None] + ["filler"] * 2
    inside = imatch.lexicon(docs_of(spark, texts), least=2, most=0.34)
    known = imatch.TermIds()
    has = lambda w: len(inside.of(imatch.terms(w, known))) == 1
    assert [has(w) for w in ("alpha", "beta", "gamma", "filler")] == [False, True, False, True]


def test_lexicon_is_exact_with_many_terms(spark):
    n = 1_500_000  # so many that first bits of ids are shared
    once = spark.range(0, n, 1000).select(F.concat_ws(" ", F.transform(F.sequence("id", F.col("id") + 999), lambda x: F.concat(F.lit("t"), x.cast("string")))).alias("text"))
    docs = once.union(spark.createDataFrame([("twice t7",), ("twice t1400007",)], "text string")).repartition(4)
    inside = imatch.lexicon(docs, most=0.5)
    known = imatch.TermIds()
    assert not len(inside.of(imatch.terms(" ".join(f"t{k}" for k in range(50_000, 90_000)), known)))
    assert len(inside.of(imatch.terms("twice t7 t1400007", known))) == 3 == len(inside.ids)


def test_edited_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 300))) for _ in range(150)] + [None, "", "x", "é" * 50, "same words here", "same words here"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in imatch.compare_edited(docs, imatch.lexicon(docs)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        t = t or ""
        following = (texts[i - 1] if i else texts[-1]) or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    n = len(texts)
    assert got[n - 1].fingerprint == got[n - 2].fingerprint and got[n - 1].near_next == 1.0
    long = [i for i in range(1, 150) if len(texts[i].split()) > 30]
    assert np.mean([got[i].near_edited for i in long]) > 0.2 > 0.02 > np.mean([got[i].near_next for i in long])
    whole = imatch.fingerprint_documents(docs, imatch.lexicon(docs)).collect()
    assert {r.doc_id: r.fingerprint for r in whole} == {i: got[i].fingerprint for i in got}


EVERY = imatch.Lexicon(np.array([], np.uint64))  # no term is in it, so all count


def brute_fingerprint(text, lexicon):
    """Per level and subset the hash of the sorted terms in it, in whole numbers; ``lexicon`` holds the words."""
    import string

    words = {w for w in text.lower().translate(str.maketrans(string.punctuation, " " * len(string.punctuation))).encode().split()}
    kept = {w for w in words if w in lexicon} or words
    if not kept:
        return None, {}
    level = len(kept).bit_length() - 1
    hashes = {}
    for k in range(3):
        for s in range(imatch.SUBSETS):
            chosen = [m for m in (plain_mix(imatch.xxhash.xxh64_intdigest(w, seed=5)) for w in kept) if m * int(imatch._FACTORS[s]) % 2**64 < 2 ** (64 - level - k)]
            total = sum(map(plain_mix, sorted(chosen))) % 2**64
            hashes[level + k, s] = plain_mix(total) % (2**16 - 1) + 1 if total else 0
    return level, hashes


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.5)), 4000)}" for _ in range(rng.randrange(0, 400))) for _ in range(120)] + [None, "", "w1", "¡ñandú! w1,w1"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in imatch.compare_edited(docs, imatch.lexicon(docs)).collect()}
    count = {}
    for t in texts:
        for w in set((t or "").lower().replace("!", " ").replace(",", " ").encode().split()):
            count[w] = count.get(w, 0) + 1
    lexicon = {w for w, n in count.items() if 2 <= n <= 0.1 * len(texts)}

    def written(level, hashes):
        return "-" if level is None else f"{level}:" + "".join(f"{hashes[level + k, s]:04x}" for k in range(3) for s in range(imatch.SUBSETS))

    def like(a, b):
        if a[0] is None or b[0] is None:
            return float(a[0] == b[0])
        if abs(a[0] - b[0]) > 2:
            return 0.0
        both = a[1].keys() & b[1].keys()
        used = [k for k in both if a[1][k] or b[1][k]]
        return sum(a[1][k] == b[1][k] for k in used) / len(used) if used else float(a == b)

    for i, t in enumerate(texts):
        following = (texts[i - 1] if i else texts[-1]) or ""
        edited = imatch.edit(t or "", following)
        own, other, after = (brute_fingerprint(x, lexicon) for x in (t or "", edited, following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (written(*own), written(*other))
        assert abs(got[i].near_edited - like(own, other)) < 1e-12 and abs(got[i].near_next - like(own, after)) < 1e-12


def test_lexicon_has_a_bound(spark):
    docs = spark.range(30_000).select(F.concat(F.lit("often"), (F.col("id") % 500).cast("string"), F.lit(" pair"), F.floor(F.col("id") / 2).cast("string")).alias("text"))
    assert len(imatch.lexicon(docs).ids) == 500  # in 60 documents each; a pair is in two, less than the share
    assert len(imatch.lexicon(docs, least_share=0.0).ids) == 15_500


def test_next_document_over_many_ranges(spark):
    ids = random.Random(5).sample(range(-500, 10**6), 300)
    docs = spark.createDataFrame([(i, f"text of {i} and its words") for i in ids], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.edited_sha256 for r in imatch.compare_edited(docs, EVERY).collect()}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        edited = imatch.edit(f"text of {i} and its words", f"text of {order[(k + 1) % len(order)]} and its words")
        assert got[i] == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprints_of_odd_tables(spark):
    inside = EVERY
    long = imatch.compare_edited(docs_of(spark, ["many words " * 300_000, "b"]), inside).collect()
    assert sorted(r.n_chars for r in long) == [1, 3_300_000]
    one = imatch.compare_edited(docs_of(spark, ["just one document"]), inside).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert imatch.compare_edited(docs_of(spark, ["x"]).limit(0), inside).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (2, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in imatch.compare_edited(twice, inside).collect()) == ["1", "1", "2", "None"]


# Pages

ARTICLE = "<h1>A   title &amp; more</h1><p>First <b>bold</b> words of the text,<br>and a second line.<p>Then &lt;this&gt; comes.</p><ul><li>one</li><li>two</li></ul><p>The end.</p>"
CLEAN = "A title & more First bold words of the text, and a second line. Then <this> comes. one two The end."


WORDS = "and so the story goes on for quite some more words than that"
SITE = "<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{}</body></html>"
LINKS = "<ul><li><a href=/a>One</a></li><li><a href=/b>Two more</a></li><li><a href=/c>And three</a></li><li><a href=/d>Four</a></li></ul>"


@pytest.fixture(scope="module")
def weights(spark):
    """Weights from the labelled pages of the table."""
    return html_content.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


PAGES = {
    "usual": SITE.format(f"<nav><a>Menu</a><a>Other</a></nav><article>{ARTICLE}</article><footer>All rights reserved by us, write to us</footer>"),
    "main": f"<body><header>Big site name</header><div class='ad'>Buy these things now for less money</div><main>{ARTICLE}</main><aside>Other news of today</aside><section id=comments><p>I like this very much indeed</p></section>",
    "form inside": f"<body><div class='cookie-notice'>This site uses cookies to be better</div><article>{ARTICLE}<form><label>Your mail</label><button>Send it</button></form></article><!-- <p>not this</p> -->",
    "no article": f"<div><div class=sidebar><ul><li><a>x</a><li><a>y</a></ul></div><div class='post-content'>{ARTICLE}</div></div>",
    "unknown classes": SITE.format(f"<div class=qx1><h3>Else</h3>{LINKS}</div><article class=zz>{ARTICLE}</article><div class=kk9>Some words of a notice that no one has seen before</div>"),
    "unknown classes, no article": SITE.format(f"<div class=qx1>{LINKS}</div><div class=zz>{ARTICLE}</div><div class=kk9>Copyright of someone</div>"),
    "unknown links inside": SITE.format(f"<article>{ARTICLE}<div class=zq>{LINKS}</div></article>"),
    "comments inside": SITE.format(f"<article>{ARTICLE}<div class=reader-feedback><p>{WORDS}</p></div><ol class=commentlist><li>{WORDS}</li></ol></article>"),
    "articles as comments": SITE.format(f"<article>{ARTICLE}<div class=u><article>{WORDS}</article><article><p>{WORDS}</article></div></article>"),
    "known advert between": SITE.format(f"<main><div>{ARTICLE.split('<ul>')[0]}</div><div class='zone adSlot-3'>{WORDS}</div><div><ul>{ARTICLE.split('<ul>')[1]}</div></main>"),
    "short article beside a long sidebar": SITE.format(f"<article>{ARTICLE}</article><div class=q7>" + f"<p>{WORDS}</p>" * 8 + "</div>"),
    "class on body": f"<body class='with-sidebar comments-open'><div id=page class=has-sidebar><article class=hentry>{ARTICLE}</article></div><div id=disqus_thread>{WORDS}</div>",
    "whole page in a form": f"<body><form id=f><nav>{LINKS}</nav><article>{ARTICLE}</article></form>",
    "header inside": f"<body><article><header><h1>A title &amp; more</h1></header>{ARTICLE.split('</h1>')[1]}<footer>Posted by someone in something</footer></article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(weights, name):
    assert html_content.main_text(PAGES[name], weights) == CLEAN


def test_main_text_without_labelled_pages():
    assert html_content.main_text(PAGES["usual"], html_content.train([])) == CLEAN


def test_learned_kinds():
    """What labelled pages say of a class they alone know, and that they can overturn a prior."""
    page = lambda k: f"<body><div class=zub>{WORDS} {k}</div><article><div class=sidebar>{WORDS} {k}</div><p>{WORDS}</p></article><div class=zub>{WORDS}</div></body>"
    learned = html_content.train([page(k) for k in range(30)])
    assert html_content.main_text(f"<body><p>{WORDS}</p><div class=zub>gone</div><p>{WORDS}</p></body>", learned) == f"{WORDS} {WORDS}"
    assert html_content.main_text(f"<body><p>{WORDS}</p><div class=sidebar>stays</div><p>{WORDS}</p></body>", learned) == f"{WORDS} stays {WORDS}"


def brute_region(scores):
    best, at = 0.0, (0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    return best, at


def test_best_region():
    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.choice([-3, -1, -0.5, 1, 2]) for _ in range(rng.randrange(0, 15))]
        a, b = html_content.best_region(scores)
        assert abs(sum(scores[a:b]) - brute_region(scores)[0]) < 1e-9


def test_region_of_whole_pages_against_brute_force(spark, weights):
    """The text is that of the best of all contiguous regions."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + list(PAGES.values())
    for page in pages:
        sequence = html_content.scored(html_content.parse(page), weights)
        assert all(s > 0 if k == "t" and v.strip() else s <= 0 for k, v, s in sequence)
        _, (a, b) = brute_region([s for *_, s in sequence])
        words = " ".join("".join(v if k == "t" else " " if v in html_content.BLOCK else "" for k, v, _ in sequence[a:b]).split())
        assert html_content.main_text(page, weights) == words


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a b='", "<a b=\"x' ", "<", "</", "<!--", "<div>", "</div>", "<b></p>", "<p><li>", "<script>", "<x a=b c='d' ", "&amp", "<div class='a b-c", "<![CDATA[", "= ' \" <i"])
def test_broken_pages_take_linear_time(weights, piece):
    began = time.time()
    html_content.main_text(piece * (1_000_000 // len(piece)), weights)
    html_content.main_text(f"<article>{ARTICLE}" + piece * (100_000 // len(piece)), weights)
    assert time.time() - began < 30


def test_odd_pages(spark, weights):
    for page in (None, "", "plain words only", "<", "<p", "<!-- x", "<script>x", "<a href='x>y</a> z", "</div>" * 50, "<div>" * 5000 + "deep"):
        assert isinstance(html_content.main_text(page, weights), str)
    assert html_content.main_text("<p>1 < 2 and <a href='x>three</a> four</p>", weights) == "1 < 2 and three four"
    pages = spark.createDataFrame([(1, "u", None, "t", 1, 2), (1, "u", f"<article>{ARTICLE}</article>", "t", 1, 2), (None, None, "", "t", 1, 2)], "page_id long, url string, html string, text string, _id long, _html long")
    got = html_content.extract_text(pages, html_content.fit(pages)).collect()
    assert sorted(r.text for r in got) == ["", "", CLEAN]
    assert html_content.extract_text(pages, weights, keep=("text", "_id")).columns == ["page_id", "_id", "text"]
    assert html_content.extract_text(pages.limit(0), html_content.fit(pages.limit(0))).count() == 0


def test_pages_of_the_table(spark, weights):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_content.extract_text(pages, weights).withColumnRenamed("text", "got").join(pages, ["page_id", "url"]).collect()
    assert len(got) == pages.count()
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
        assert r.got == want
        # Without the labelling element the scan has only words and tags to go by.
        assert html_content.main_text(re.sub("</?article>", "", r.html), weights) == want


# Toxicity


def toxic_corpus(n=1500, seed=7):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(800)}" for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "vilesome", "wretch", "scoundrel"]))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_holds_out(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame([*docs, (5000, None), (5001, ""), (None, "wretch")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")  # noqa: E741
    model = toxicity.fit(d, l)
    rows = toxicity.score(d, model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(rows) == len(docs) + 3 and all(0 <= r.score <= 1 for r in rows)
    truth = dict((i, t) for i, _, t in labels)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.8 and np.mean([s >= 0.7 for s in bad]) < 0.02
    # Labels of held-out rows change nothing.
    turned = l.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(d, turned).weights, model.weights)


def test_scores_against_brute_force(spark):
    """Every score is the curve of the summed weights, worked out feature by feature."""
    docs, labels = toxic_corpus(400, 3)
    d = spark.createDataFrame([*docs, (9000, "vilest " * 300_000), (9001, None), (9001, "twice"), (9001, "twice")], "doc_id long, text string")
    twice = spark.createDataFrame([*labels, *labels[:50], (labels[0][0], 1, 1 - labels[0][2]), (7777777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, twice)
    again = toxicity.fit(d.union(d.limit(100)).repartition(5), twice)
    assert np.array_equal(model.weights, again.weights) and (model.slope, model.shift) == (again.slope, again.shift)
    for r in toxicity.score(d, model, keep=("text",)).collect():
        names = {x for w in toxicity.WORD.findall((r.text or "").lower()) for x in ("=" + w, *("^" + w[:n] for n in toxicity.STEMS if len(w) > n))}
        margin = sum(model.weights[k] for k in {toxicity.xxhash.xxh32_intdigest(x) >> (32 - toxicity.FEATURE_BITS) for x in names}) + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-9


def test_curve_needs_no_clean_documents():
    """The minimum of the corrected risk, against a grid; the mean score of the unlabelled is the prior."""
    rng = np.random.default_rng(2)
    positive, unlabelled = rng.normal(2, 1, 400), np.concatenate([rng.normal(2, 1, 120), rng.normal(-1, 1, 880)])
    a, b = toxicity.calibrate(positive, unlabelled, 0.12)
    risk = lambda a, b: np.logaddexp(0, a * unlabelled + b).mean() - 0.12 * (a * positive + b).mean()
    assert risk(a, b) <= min(risk(x, y) for x in np.linspace(0.1, 6, 60) for y in np.linspace(-8, 4, 121)) + 1e-3
    assert abs((1 / (1 + np.exp(-a * unlabelled - b))).mean() - 0.12) < 1e-3


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score < 0.7 for r in toxicity.score(d, toxicity.fit(d, none)).collect())
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), none)).count() == 0


def test_risk_is_kept_non_negative():
    rng = np.random.default_rng(1)
    positive = [np.array([0, *rng.integers(2, 40, 3)]) for _ in range(60)]
    unlabelled = [np.unique([*([0] if rng.random() < 0.2 else [1]), *rng.integers(2, 40, 3)]) for _ in range(300)]
    w, b = toxicity.nn_pu([np.unique(p) for p in positive], unlabelled, 0.2, 40)
    assert w[0] + b > 0 > w[1] + b
