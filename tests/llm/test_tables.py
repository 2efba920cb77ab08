"""Shards, URL filters, the queries and the pipeline."""

import math
import random
import zlib
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import duck, duck_rows, spark_rows
from lectorium.llm import queries, sharding, toxicity, url_filter

FOLDER = "/root/testdata/sf0.001"


def shards(spark, rows, n=5, partitions=4):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    return sharding.shard_by_bytes(sharding.size_documents(df), n, partitions=partitions).collect()


def test_shards_follow_the_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(200) if i % 9 else None, "x") for i in rng.sample(range(10**6), 300)]
    got = {r.doc_id: r for r in shards(spark, rows)}
    total = sum(len((t or "").encode()) + 8 for _, t, _ in rows)
    at, slots = 0, {}
    for i, t, _ in sorted(rows):
        size = len((t or "").encode()) + 8
        k = (2 * at + size) * 5 // (2 * total)
        assert (got[i].size, got[i].start_byte, got[i].shard, got[i].slot) == (size, at, k, slots.get(k, 0))
        assert got[i].text_crc32 == zlib.crc32((t or "").encode())
        slots[k] = slots.get(k, 0) + 1
        at += size


def test_shards_of_odd_tables(spark):
    assert shards(spark, []) == []
    one = shards(spark, [(None, None, "x")])
    assert (one[0].size, one[0].slot) == (8, 0)
    twice = shards(spark, [(1, "a", "x")] * 7 + [(2, "b" * 100_000, "x")], n=3)
    for k in {r.shard for r in twice}:
        assert sorted(r.slot for r in twice if r.shard == k) == list(range(sum(r.shard == k for r in twice)))
    assert len(twice) == 8


def test_shards_keep_columns_of_any_name(spark):
    names = ["_bytes", "_tie", "_part", "_rank", "_b0", "_b", "_n", "_all", "_first", "_before", "_begin", "_every", "shard"]
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(9).cast("long").alias("size"), *[F.lit(k).alias(c) for k, c in enumerate(names)])
    got = sharding.shard_by_bytes(df, 4, partitions=3).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == [(i, i // 5, i % 5) for i in range(20)]
    assert all(r[c] == k for r in got for k, c in enumerate(names[:-1]))


HOSTS = [("http://A.Example.com/x", "a.example.com"), ("https://u:p@b.org:80?q", "b.org"), ("ftp://c.d./", "c.d"), ("no url", None), ("", None), (None, None), ("http://[::1]:8/", "[::1]"), ("http:///x", None)]


def test_hosts(spark):
    df = spark.createDataFrame(HOSTS, "url string, want string").withColumn("got", url_filter.url_host(F.col("url")))
    assert all(r.got == r.want for r in df.collect())
    parents = spark.createDataFrame([("a.b.c",), ("x",), ("a.b",)], "h string").select(url_filter.parent_domains(F.col("h"))).collect()
    assert [r[0] for r in parents] == [["a.b.c", "b.c"], ["x"], ["a.b"]]
    long = ".".join(f"l{k}" for k in range(200))
    odd = spark.createDataFrame([(long,), ("10.1.2.3",), ("[::ffff:1.2.3.4]",), ("1.com",)], "h string").select(url_filter.parent_domains(F.col("h"))).collect()
    assert len(odd[0][0]) == 199 and odd[0][0][0] == long and odd[0][0][-1] == "l198.l199"
    assert [r[0] for r in odd[1:]] == [["10.1.2.3"], ["[::ffff:1.2.3.4]"], ["1.com"]]


def test_addresses_and_long_names(spark):
    long = ".".join(f"l{k}" for k in range(200)) + ".z.org"
    day = date(2024, 3, 1)
    c = spark.createDataFrame([(1, "http://10.1.2.3/", day), (2, "http://[::2.3]/", day), (3, f"http://{long}/", day), (4, "http://2.3/", day)], "page_id long, url string, fetched_on date")
    e = spark.createDataFrame([("2.3", "ads", day, "add"), ("z.org", "ads", day, "add")], "domain string, category string, effective_on date, action string")
    assert {r.page_id: r.matched_domain for r in url_filter.filter_urls(c, e).collect()} == {1: None, 2: None, 3: "z.org", 4: "2.3"}


def test_temporal_join_against_replay(spark):
    rng = random.Random(2)
    start = date(2024, 1, 1)
    domains = ["a.com", "x.a.com", "b.org", "c.b.org", "d.net"]
    entries = [(rng.choice(domains), rng.choice(["ads", "spam"]), start + timedelta(rng.randrange(60)), rng.choice(["add", "remove"])) for _ in range(70)]
    entries += [(None, "ads", start, "add"), ("d.net", None, start, "add"), ("d.net", "ads", None, "add"), ("d.net", "ads", start, "other"), ("A.com", "ads", start, "add")]
    captures = [(i, f"http://{rng.choice(['', 'w.', 'x.'])}{rng.choice(domains)}/p", start + timedelta(rng.randrange(70))) for i in range(200)] + [(900, None, start), (901, "http://a.com/", None), (902, "junk", start)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").withColumn("category", F.lit("clash"))
    e = spark.createDataFrame(entries, "domain string, category string, effective_on date, action string")
    got = {r.page_id: r for r in url_filter.filter_urls(c, e).collect()}
    assert len(got) == len(captures)

    def active(domain, category, day):
        mine = [(x[2], x[3]) for x in entries if x[0] and x[0].lower() == domain and x[1] == category and x[2] and x[3] in ("add", "remove") and x[2] <= day]
        if not mine:
            return False
        last = max(m[0] for m in mine)
        return "remove" not in [a for d, a in mine if d == last]

    for i, url, day in captures:
        host = url.split("/")[2] if url and "//" in url else None
        labels = host.split(".") if host else []
        names = [".".join(labels[k:]) for k in range(len(labels) - 1)]
        hits = [(d, k) for d in names for k in ("ads", "spam") if day and active(d, k, day)]
        assert got[i].blocked is bool(hits)
        assert (got[i].matched_domain, got[i].category) == (hits[0] if hits else (None, None))
    assert url_filter.filter_urls(c.limit(0), e).count() == 0
    assert url_filter.filter_urls(c, e.limit(0)).where("blocked").count() == 0
    assert url_filter.filter_urls(c.union(c), e).count() == 2 * len(captures)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    names, rows = duck_rows(duck(FOLDER), queries.oracle_sql()[name])
    assert sorted(df.columns) == names and spark_rows(df) == rows


def test_other_queries(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op2_merge_dropout", "op5_imatch", "op6_byte_shards", "op7_toxicity"):
        assert queries.queries()[name](spark, FOLDER).count() == docs
    assert queries.queries()["op2_merge_dropout"](spark, FOLDER).where("not lossless").count() == 0
    sizes = [r[1] for r in queries.queries()["op6_byte_shards"](spark, FOLDER).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) <= 24 and max(sizes) - sum(sizes) / 24 <= 20_000


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what the one before has left."""
    from test_dedup import brute_lines, brute_near

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = [(r.doc_id, r.text, r.source) for r in left.collect()]
        if name == "toxicity":
            model = toxicity.fit(left, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            kept = {r.doc_id for r in toxicity.score(left, model).collect() if r.score < 0.7}
            assert {r.doc_id for r in out.collect()} == kept
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in out.collect()} == brute_lines(before, 10)
            assert all(r.n_chars == len(r.text or "") for r in out.collect())
        elif name == "near_dedup":
            assert {r.doc_id for r in out.collect()} == {i for i, _, _, kept in brute_near(before) if kept}
        else:
            got = out.agg(F.countDistinct("doc_id"), F.sum("length"), F.countDistinct("sequence_id")).first()
            assert got[0] == len(before) and got[2] == math.ceil(got[1] / 2048)
        left = out


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "text without an id", "en", "s", 18), (3, "the same words are here twice", "en", "s", 29), (4, "the same words are here twice", "en", "s", 29)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("_id", F.lit(2)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "None"]
    empty = str(tmp_path / "empty")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
