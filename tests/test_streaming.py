import pytest
from pyspark.sql import functions as F

from lectorium.operators import sequences as seq
from lectorium.streaming import activity


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def feed(spark, tmp_path):
    """A stream of the files of a folder, one file a batch."""

    def make(batches, schema):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    return make


def test_sessions_equal_the_batch_form(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0]
    path = str(tmp_path / "e")
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    got = run(activity.session_stream(stream, gap="6 hours", late="40 days", shortest=0), "sessions_out", "append")
    batch = seq.sessions(events, "user_id", "ts", 6 * 3600)
    # The watermark has not passed, so an append stream has given out nothing wrong: all it gave is in the batch form.
    assert got.join(batch, ["user_id", "session_start", "session_end", "n_events"], "left_anti").count() == 0
    assert last is not None


def test_accepted_writes(spark, feed):
    schema = "user_id int, key string, value string, at_ms double, seq int"
    stream = feed([[(1, "pos", "a", 5.0, 0), (1, "pos", "b", 5.0, 1)], [(1, "pos", "late", 4.0, 2), (2, "pos", None, 0.0, 3)], [(1, "pos", "c", None, 4)]], schema)
    rows = run(activity.accept_writes(stream), "writes_out", "update").collect()
    last = {}
    for r in rows:
        last[r.user_id] = r.value
    assert last[1] == "b" and 2 in last


def test_crossings(spark, feed):
    schema = "user_id int, seq long, value double"
    stream = feed([[(1, 0, 90.0), (1, 1, 98.0)], [(1, 2, 101.0), (2, 3, 10.0)], [(2, 4, 150.0), (1, 5, 99.0), (1, 6, 103.0)]], schema)
    got = sorted((r.user_id, r.seq) for r in run(activity.crossing_stream(stream, 100.0, 50.0), "cross_out", "append").collect())
    assert set(got) <= {(1, 2), (1, 6)} and got


def test_daily_sums(spark, feed):
    stream = feed([[("d1", 5.0, 10.0), ("d1", -3.0, 2.0)], [("d2", 1.0, None)]], "day string, sec double, words double")
    got = {r.day: (r.sec, r.words) for r in run(activity.daily_stream(stream, ["day"], "sec", "words"), "daily_out", "complete").collect()}
    assert got == {"d1": (5.0, 12.0), "d2": (1.0, 0.0)}


def test_last_good(spark, feed):
    stream = feed([[("x", 0, "{}")], [("x", 1, None)], [("x", 2, "{1}")]], "device string, seq long, state string")
    rows = run(activity.keep_last_good(stream), "good_out", "update").collect()
    assert all(r.state for r in rows) and max(rows, key=lambda r: r.seq).state == "{1}"


def test_translated_writes(spark):
    writes = spark.createDataFrame([(1, 5.0, "old"), (2, 5.0, "now"), (3, 5.0, "gone")], "id int, value double, edition string")
    editions = spark.createDataFrame([("old", "now", [0, 10])], "edition string, cur string, map array<int>").select("edition", "map")
    got = activity.translate_late(writes.withColumn("now", F.lit("now")), editions)
    assert {r.id: r.value for r in got.collect()} == {1: 10.0, 2: 5.0}


def test_replanning(spark, feed, tmp_path):
    """After each change the plan is that of the copies as they are then."""
    stream = feed([[("x",)], [("y",)]], "book string")
    states = iter([[("a", "absent", False), ("b", "outdated", True), ("c", "here", False)], [("a", "here", False), ("b", "outdated", False), ("c", "here", False)]])
    more = ", skipped boolean, done boolean, signature string, failed_signature string"
    copies = lambda: spark.createDataFrame([(*x, None, False, "s", None) for x in next(states)] + [("d", "absent", False, True, False, "s", None), ("e", "absent", False, False, False, "s", "s"), ("f", "absent", False, False, True, "s", None)], "book string, state string, busy boolean" + more)
    plans = []
    query = activity.replanned(stream, copies, lambda df: plans.append(sorted(r.book for r in df.collect())), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert query.exception() is None and plans == [["a"], ["b"]]


def test_sessions_are_handed_on_in_order(spark, feed, tmp_path):
    stream = feed([[(2, "b"), (1, "a")], [(4, "d"), (3, "c")]], "seq int, what string")
    saved, tries = [], []

    def put(rows):
        tries.append(len(rows))
        if len(tries) == 2:
            raise ConnectionError("away")
        saved.extend(r.what for r in rows)

    first = activity.delivered(stream, put, str(tmp_path / "c"))
    with pytest.raises(Exception, match="away"):
        first.awaitTermination(120)
    assert saved == ["a", "b"]
    activity.delivered(stream, put, str(tmp_path / "c")).awaitTermination(120)
    assert saved == ["a", "b", "c", "d"]
