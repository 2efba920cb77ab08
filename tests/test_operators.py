import random

from pyspark.sql import functions as F

from lectorium.operators import alignment as al
from lectorium.operators import catalogue as cat
from lectorium.operators import library as lib
from lectorium.operators import sequences as seq
from lectorium.operators import state as st
from lectorium.queries import QUERIES


def test_last_writer_wins(spark):
    rows = [("b", 1, "pos", 1.0, "x"), ("b", 2, "pos", 5.0, None), ("b", 3, "pos", 5.0, "z"), ("b", 1, "mode", None, "m"), ("b", 2, "mode", 0.0, "n")]
    df = spark.createDataFrame(rows, "slug string, device int, key string, at_ms double, value string")
    got = {r.key: (r.value, r.at_ms) for r in st.last_writer_wins(df, ["slug", "key"], "at_ms", ["device"], ["value"]).collect()}
    assert got == {"pos": (None, 5.0), "mode": ("m", 0.0)}  # a null value wins; of equal times the first device


def test_status(spark):
    cases = [
        ("done", 9, 1, False, 0, "done"), ("reading", 0, 9, True, 0, "reading"), ("paused", 5, 4, False, 0, "reading"), ("paused", 4, 4, True, 0, "paused"),
        ("library", 1, 2, False, 900, "paused"), (None, 0, 0, True, 0, "done"), (None, 0, 0, False, 601, "reading"), (None, 0, 0, False, 600, "none"), ("other", 0, 0, False, 0, "none"),
    ]
    df = spark.createDataFrame(cases, "shelf string, mode_at int, shelf_at int, at_end boolean, sec int, expect string")
    got = df.withColumn("s", st.status(*map(F.col, ("shelf", "mode_at", "shelf_at", "at_end", "sec")))).collect()
    assert [r.s for r in got] == [r.expect for r in got]


def test_places(spark):
    maps = F.create_map(F.lit("old"), F.array(F.lit(3), F.lit(4), F.lit(9)))
    df = spark.createDataFrame([(1.9, "old"), (-5.0, "old"), (99.0, "old"), (7.0, "now"), (7.0, None), (7.0, "gone")], "s double, e string")
    got = [r[0] for r in df.select(st.translate_place(F.col("s"), F.col("e"), F.lit("now"), maps)).collect()]
    assert got == [4.0, 3.0, 9.0, 7.0, 7.0, None]
    assert spark.range(1).select(st.compose_map(F.array(F.lit(0), F.lit(2), F.lit(9)), F.array(F.lit(5), F.lit(6), F.lit(7)))).first()[0] == [5, 7, 7]


def test_streak(spark):
    days = [("a", "2024-01-31"), ("a", "2024-01-30"), ("a", "2024-01-28"), ("b", "2024-01-30"), ("b", "2024-01-29"), ("c", "2024-01-20"), ("d", "2024-02-05")]
    df = spark.createDataFrame(days, "u string, day string").withColumn("day", F.to_date("day"))
    assert {r.u: r.streak for r in st.streak(df, "u", "day", "2024-01-31").collect()} == {"a": 2, "b": 2, "c": 0}


def test_asof(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 2.7), (2, 9.0), (3, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b"), (2, 10.0, "c")], "k int, at double, v string")
    got = {(r.k, r.t): r.v for r in seq.asof(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {(1, 0.5): None, (1, 1.0): "a", (1, 2.7): "b", (2, 9.0): None, (3, 1.0): None}
    got = {(r.k, r.t): r.v for r in seq.asof(left, right, ["k"], "t", "at", ["v"], first_if_none=True).collect()}
    assert got[(1, 0.5)] == "a" and got[(2, 9.0)] == "c" and got[(3, 1.0)] is None


def brute_interpolate(words, duration):
    known = [i for i, w in enumerate(words) if w[1] is not None]
    weight = [w[0] + 1 for w in words]
    t = [w[1] for w in words]
    rate = (t[known[-1]] - t[known[0]]) / (sum(weight[known[0] : known[-1]]) or 1)
    out = []
    for i in range(len(words)):
        before = [k for k in known if k <= i]
        after = [k for k in known if k >= i]
        if i in known:
            x = t[i]
        elif not before:
            x = max(0.0, t[after[0]] - sum(weight[i : after[0]]) * rate)
        elif not after:
            x = min(duration, t[before[-1]] + sum(weight[before[-1] : i]) * rate)
        else:
            a, b = before[-1], after[0]
            x = t[a] + sum(weight[a:i]) * (t[b] - t[a]) / sum(weight[a:b])
        out.append(x)
    return out


def test_interpolate(spark):
    rng = random.Random(1)
    for _ in range(3):
        times, now = [], 5.0
        for _ in range(30):
            now += rng.random() * 3
            times.append(round(now, 2))
        words = [(rng.randint(1, 9), times[i] if rng.random() < 0.3 or i == 12 else None) for i in range(30)]
        df = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(words)], "b int, w int, n int, t double")
        got = seq.interpolate(df, ["b"], "w", "t", F.col("n") + 1, F.lit(60.0)).orderBy("w").collect()
        assert all(abs(r.t0 - x) < 0.002 for r, x in zip(got, brute_interpolate(words, 60.0)))
        assert all(r.t1 > r.t0 for r in got)


def test_time_fixes(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 0.5, 0.6, 3.0, 2.0])], "k int, i int, t double")
    assert [round(r.fixed, 2) for r in seq.fix_times(df, "k", "i", "t").orderBy("i").collect()] == [1.0, 1.01, 1.02, 3.0, 3.01]
    anchors = spark.createDataFrame([(1, 3 * i, float(x), x + 0.5) for i, x in enumerate([0, 50, 120, 121, 300, 310])] + [(2, 0, 1.0, 1.5)], "k int, i int, t double, e double")
    windows = seq.greedy_windows(anchors, "k", "i", "t", "e", F.lit(313.0)).orderBy("window_no").collect()
    assert [tuple(r)[1:] for r in windows] == [(0, 0, 5, 0.0, 120.0), (1, 6, 11, 120.0, 300.0), (2, 12, 15, 300.0, 313.0)]


def test_aligned_times(spark):
    rows = [(1, 0, 1.0, 1.4, -1.0, 9.0, 9.5), (1, 1, 0.5, 0.5, -2.0, 9.0, 9.5), (1, 2, 7.0, 8.0, -9.0, 2.0, 2.2), (1, 3, None, None, None, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "k int, i int, found0 double, found1 double, score double, given0 double, given1 double")
    assert [(r.t0, r.t1) for r in seq.aligned_times(df, ["k"], "i", F.lit(4.0)).orderBy("i").collect()] == [(1.0, 1.01), (1.01, 1.06), (2.0, 2.2), (3.0, 4.0)]


def test_nearest_above(spark):
    rng = random.Random(12)
    levels = [rng.randrange(5) for _ in range(60)]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(levels)], "b int, i int, n int")
    got = {r.i: r.parent for r in seq.nearest_above(df, ["b"], "i", "n", 5, "i").collect()}
    assert got == {i: max((j for j in range(i) if levels[j] < n), default=None) for i, n in enumerate(levels)}


def test_medians_and_draws(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 3, None, 3)] + [("b", 2), ("b", 9)], "k string, v int")
    assert {r.k: r["median"] for r in cat.upper_median(df, ["k"], "v").collect()} == {"a": 3, "b": 9}
    lines = spark.range(40).select((F.col("id") % 4).alias("k"), "id")
    one = {r.k: r.id for r in cat.drawn(lines, ["k"], ["id"], F.col("id") >= 32, 1).collect()}
    assert all(v >= 32 for v in one.values()) and one == {r.k: r.id for r in cat.drawn(lines.repartition(3), ["k"], ["id"], F.col("id") >= 32, 1).collect()}
    assert {r.k: r.id for r in cat.drawn(lines, ["k"], ["id"], F.lit(False), 2).collect()} != {r.k: r.id for r in cat.drawn(lines, ["k"], ["id"], F.lit(False), 3).collect()}
    hits = spark.createDataFrame([("q", 1, True, 100), ("q", 2, True, 10), ("q", 3, False, 1), ("q", 4, True, 0), ("q", 5, True, 90)], "q string, id int, rel boolean, s int")
    assert {r.id: (r.other, r.expected, r.fragment) for r in cat.judged(hits, ["q"], F.col("rel"), "s").collect()} == {1: (False, 90, False), 2: (False, 90, True), 3: (True, 90, False), 4: (False, 90, False), 5: (False, 90, False)}


def test_moving_books(spark):
    mine = spark.createDataFrame([("1", "a", True), ("", "b", True), ("3", "b-2", True), ("4", "c", False), ("5", "c-9", True)], "id string, slug string, movable boolean")
    there = spark.createDataFrame([("1", "old"), ("", "b"), ("9", "c")], "id string, slug string")
    got = {r.slug: (r.outcome, r.target) for r in lib.move_books(mine, there).collect()}
    assert got == {"a": ("already", "old"), "b": ("moved", "b-2"), "b-2": ("moved", "b-2-2"), "c": ("failed", "c-2"), "c-9": ("moved", "c-9")}


def test_maps_in_rows(spark):
    older = spark.createDataFrame([("b", "e0", 0, 2), ("b", "e0", 1, 9), ("b", "e1", 0, 0), ("c", "e0", 0, 0)], "book string, edition string, place int, value int")
    newer = spark.createDataFrame([("b", k, v) for k, v in enumerate([5, 6, 7])], "book string, place int, value int")
    got = sorted(tuple(r) for r in st.lead_on(older, newer, ["book"], F.lit("e1")).select("book", "edition", "place", "value").collect())
    assert got == [("b", "e0", 0, 7), ("b", "e0", 1, 7), ("b", "e1", 0, 5), ("b", "e1", 1, 6), ("b", "e1", 2, 7)]


def test_own_days(spark):
    day = lambda rows: spark.createDataFrame(rows, "d string, sec double, words int")
    got = sorted(tuple(r) for r in st.join_own_days(day([("1", 5.0, 1), ("2", None, 3)]), day([("1", 4.0, 9), ("3", 1.0, None)]), ["d"], ["sec", "words"]).collect())
    assert got == [("1", 5.0, 9), ("2", 0.0, 3), ("3", 1.0, 0)]


def test_text_loss(spark):
    blocks = lambda rows: spark.createDataFrame(rows, "b string, words int, picture string")
    old = blocks([("x", 100, "p"), ("x", 0, None), ("y", 100, "p"), ("z", 100, None)])
    new = blocks([("x", 97, None), ("x", 0, "p"), ("y", 100, "q")])
    assert sorted(tuple(r) for r in lib.text_loss(old, new, ["b"]).collect()) == [("x", 100, 97, 0, False), ("y", 100, 100, 1, True), ("z", 100, 0, 0, True)]


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_chain_is_the_longest_run():
    rng = random.Random(2)
    for _ in range(50):
        pairs = [(rng.randrange(12), j) for j in range(10)]
        best = max((sum(1 for _ in c) for m in range(1 << 10) for c in [[pairs[k] for k in range(10) if m >> k & 1]] if all(x[0] < y[0] for x, y in zip(c, c[1:]))), default=0)
        got = [pairs[k] for k in al.longest_rise([i for i, _ in pairs])]
        assert len(got) == best and all(x[0] < y[0] for x, y in zip(got, got[1:]))


def test_window_match():
    rng = random.Random(3)
    text = prose(rng, 9000, 3000)
    for spoken, least in ((text, 1.0), (text[2000:], 1.0), (text[:3000] + text[5000:], 0.99)):
        runs = al.window_match(text, spoken)
        assert sum(n for *_, n in runs) >= least * len(spoken)
        assert all(text[i : i + n] == spoken[j : j + n] for i, j, n in runs)
        assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(runs, runs[1:]))
    other = prose(random.Random(9), 6000, 3000)
    assert sum(n for *_, n in al.window_match(text, other)) / len(other) < 0.02


def test_word_match_and_sentence_map():
    rng = random.Random(5)
    old = prose(rng, 3000, 900)
    new = [w for k, w in enumerate(old) if k % 97] + ["tail"]
    place = al.word_match(old, new)
    hits = [(k, m) for k, m in enumerate(place) if m >= 0]
    assert all(old[k] == new[m] for k, m in hits) and all(x[1] < y[1] for x, y in zip(hits, hits[1:]))
    assert len(hits) > 0.95 * len(old)
    lines = [["a", "b"], ["c", "d"], ["e"], [], ["f", "g"]]
    assert al.sentence_map(lines, lines) == [0, 1, 2, 4, 4]
    assert al.sentence_map(lines, [lines[0], lines[2], lines[4]]) == [0, 1, 1, 2, 2]
    assert al.sentence_map(lines, []) == [0] * 5


def test_long_stretches_are_matched_between_fixed_points():
    """Without common ends, and too long for difflib as a whole."""
    rng = random.Random(21)
    common = [f"u{k}" for k in range(0, 1500, 3)]
    side = lambda tag: [x for k, w in enumerate(common) for x in (w, *(f"{tag}{k}" for _ in range(rng.randrange(4))))]
    old, new = ["o"] + side("a") + ["p"], ["n"] + side("b") + ["m"]
    place = al.word_match(old, new)
    assert [new[m] for m in place if m >= 0] == common
    assert al.word_match(["a"] * 600, ["b"] * 600) == [-1] * 600 and al.word_match([], ["a"]) == []


def test_sentence_map_of_lost_words():
    old = [["a", "b", "c"], ["x1"], ["x2"], ["x3"], ["d", "e"]]
    assert al.sentence_map(old, [["a", "b", "c"], ["y"], ["d", "e"]]) == [0, 1, 2, 2, 2]
    assert al.sentence_map([["q"], ["r"]], [["a"], ["b"], ["c"], ["d"]]) == [0, 2]
    assert al.sentence_map([[], []], [["a"], ["b"]]) == [1, 1] and al.sentence_map([["a"]], [[], []]) == [1]


def test_two_key_dedupe(spark):
    rows = [("q", 1, "A", "X"), ("q", 2, "B", "X"), ("q", 3, "B", "Y"), ("q", 4, "C", None), ("q", 5, "D", None)]
    df = spark.createDataFrame(rows, "q string, pos int, link string, file string")
    assert sorted(r.pos for r in cat.first_of_two_keys(df, ["q"], ["pos"], "link", "file").collect()) == [1, 3, 4, 5]


def test_editions(spark):
    rows = [(1, "a", 2), (2, "a", 1), (3, "a", 2), (4, "a", None), (5, "b", None)]
    df = spark.createDataFrame(rows, "id int, k string, vol int")
    got = sorted((r.k, list(r.parts)) for r in cat.editions(df, ["k"], F.col("vol"), ["id"], F.col("id")).collect())
    assert got == [("a", [2, 1]), ("a", [4]), ("b", [5])]


def test_modes_and_names(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "g int, v string, p int")
    assert cat.first_mode(df, ["g"], "v", "p").first().mode_value == "b"
    assert cat.small_mode(df, ["g"], "v").first().mode_value == "a"
    assert sorted(r.unique_name for r in cat.unique_names(df, "v", ["p"]).collect()) == ["a", "a-2", "b", "b-2"]


def test_copies(spark):
    taken = spark.range(1).select(lib.greedy_fit(F.expr("array(struct(1L as id, 30D as size), struct(2L as id, 60D as size), struct(3L as id, 20D as size))"), F.lit(120.0), 10)).first()[0]
    assert taken == [1, 3]
    maps = spark.sql("select map('a', 1, 'b', 2) x, map('b', 2, 'a', 1) y, map() z")
    state = lambda here, mine, own: maps.select(lib.copy_state(F.lit(here), F.lit(mine), F.lit("e"), own.cast("map<string, int>"), F.col("y"))).first()[0]
    assert [state(False, "e", F.col("x")), state(True, "d", F.col("x")), state(True, "e", F.col("z")), state(True, "e", F.col("x"))] == ["absent", "outdated", "textOnly", "here"]


def test_updates(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "id int, title string, note string")
    patch = spark.createDataFrame([(1, " ", None), (2, "C", "z")], "id int, title string, note string")
    assert sorted(tuple(r) for r in lib.update_by_id(rows, patch, "id", ["title", "note"], "title").collect()) == [(1, "A", "x"), (2, "C", "z")]
    new = spark.createDataFrame([(3, "a", ""), (4, "D", "")], "id int, title string, note string")
    assert sorted(r.id for r in lib.insert_unless_title(rows, new, "title").collect()) == [1, 2, 4]
    assert [r.id for r in lib.delete_by(rows, new.withColumn("id", F.lit(1)), "id").collect()] == [2]


def test_alignment_queries_take_long_texts_and_all_languages(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    spoken = {1: words(120), 2: words(90)}
    long = [*words(1500), *spoken[1][:70], *words(1700), *spoken[1][70:], *words(40)]
    texts = [(1, long, "en"), (2, [*words(30), *spoken[2], *words(20)], "de"), (3, words(25), "en"), (4, [*spoken[1], *spoken[1]], "fr")]
    lines = {i: [w[k : k + 9] for k in range(0, len(w), 9)] for i, w, _ in texts}
    text = {i: "\n".join(map(" ".join, x)) for i, x in lines.items()}
    assert len(text[1]) > 4000
    rows = [(i, text[i], lang) for i, _, lang in texts] + [(5, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in spoken.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = lambda w: [tuple(w[k : k + 4]) for k in range(len(w) - 3)]
    met = [(i, j) for i, w, _ in texts for j, s in spoken.items() if any(grams(w).count(g) == 1 for g in set(grams(s)))]
    assert {(1, 1), (2, 2)} <= set(met)
    whole = {i: w for i, w, _ in texts}
    kernels = {"q_chain": al.chain, "q_chunk_match": al.window_match, "q_word_match": lambda a, b: [(k, m) for k, m in enumerate(al.word_match(a, b)) if m >= 0]}
    for name, kernel in kernels.items():
        got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted((i, j, *x) for i, j in met for x in kernel(whole[i], spoken[j])), name
    assert sum(n for i, j, _, _, n in (tuple(r) for r in QUERIES["q_chunk_match"](spark, str(tmp_path)).collect()) if (i, j) == (1, 1)) >= 110
    got = sorted(tuple(r) for r in QUERIES["q_sentence_map"](spark, str(tmp_path)).collect())
    assert got == sorted((i, *x) for i, l in lines.items() for x in enumerate(al.sentence_map(l, l[:2] + l[3:])))
