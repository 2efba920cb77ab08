"""Queries over reading activity: ``events`` stands in for what devices write.

A user is a book's reader, the event id modulo 3 a device, the event type a key, the day
the write's time, so that equal times occur; ``props.k`` is the dependent value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clamp, clock_seconds, floor_to_tenth, js_round
from ..operators import sequences as seq
from ..operators import state as st
from ..registry import Tables, query

TODAY = "2024-01-31"
DAY_MS = 86_400_000


def _writes(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        "event_id",
        "user_id",
        (F.col("event_id") % 3).alias("device"),
        F.col("event_type").alias("key"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("pct"),
        (F.unix_date(F.col("ts").cast("date")).cast("long") * DAY_MS).cast("double").alias("at_ms"),
        F.col("ts").cast("date").alias("day"),
        "ts",
    )


_WRITES = """
WITH w AS (
  SELECT event_id, user_id, event_id % 3 AS device, event_type AS key, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pct,
         CAST(epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS DOUBLE) AS at_ms, CAST(ts AS DATE) AS day, ts
  FROM events
)
"""


@query(_WRITES + """
SELECT user_id, key, value, pct, at_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY at_ms DESC, device, event_id) AS rn FROM w
) WHERE rn = 1
""")
def q_state_lww(t: Tables) -> DataFrame:
    return st.last_writer_wins(_writes(t), ["user_id", "key"], "at_ms", ["device", "event_id"], ["value", "pct"])


@query(_WRITES + """
SELECT user_id, CAST(day AS VARCHAR) AS day, round(sum(coalesce(value, 0)), 4) AS sec, CAST(sum(coalesce(pct, 0)) AS DOUBLE) AS words, count(*) AS writes
FROM w WHERE key IN ('view', 'click') GROUP BY ALL
""")
def q_state_stats(t: Tables) -> DataFrame:
    return _stats(t).withColumn("day", F.col("day").cast("string"))


def _stats(t: Tables) -> DataFrame:
    w = _writes(t).where(F.col("key").isin("view", "click"))
    return w.groupBy("user_id", "day").agg(
        F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("sec"), F.sum(F.coalesce("pct", F.lit(0.0))).alias("words"), F.count(F.lit(1)).alias("writes")
    )


_STATS = _WRITES + """
, stats AS (SELECT user_id, day, round(sum(coalesce(value, 0)), 4) AS sec, sum(coalesce(pct, 0)) AS words FROM w WHERE key IN ('view', 'click') GROUP BY ALL)
"""


@query(_STATS + """
SELECT u.user_id, CAST(d.day AS VARCHAR) AS day, coalesce(s.sec, 0) AS sec,
       round(coalesce(s.sec, 0) / greatest(60, max(coalesce(s.sec, 0)) OVER (PARTITION BY u.user_id)), 6) AS bar
FROM (SELECT DISTINCT user_id FROM stats) u CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN stats s ON s.user_id = u.user_id AND s.day = d.day
""")
def q_stats_week(t: Tables) -> DataFrame:
    stats = _stats(t)
    week = F.sequence(F.date_sub(F.lit(TODAY).cast("date"), 6), F.lit(TODAY).cast("date"))
    days = stats.select("user_id").distinct().select("user_id", F.explode(week).alias("day"))
    bars = days.join(stats, ["user_id", "day"], "left").withColumn("sec", F.coalesce("sec", F.lit(0.0)))
    scale = F.greatest(F.lit(60.0), F.max("sec").over(Window.partitionBy("user_id")))
    return bars.select("user_id", F.col("day").cast("string").alias("day"), "sec", F.round(F.col("sec") / scale, 6).alias("bar"))


@query(_STATS + """
, d AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM stats WHERE sec > 60 AND day <= DATE '2024-01-31'),
r AS (SELECT user_id, run, count(*) AS n, max(day) AS last FROM d GROUP BY ALL)
SELECT user_id, max(CASE WHEN last >= DATE '2024-01-30' THEN n ELSE 0 END) AS streak FROM r GROUP BY user_id
""")
def q_stats_streak(t: Tables) -> DataFrame:
    return st.streak(_stats(t).where("sec > 60"), "user_id", "day", TODAY)


_MERGED = _WRITES + """
, lww AS (
  SELECT user_id, key, value, at_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY at_ms DESC, device, event_id) AS rn FROM w) WHERE rn = 1
), m AS (
  SELECT u.user_id,
         CASE CAST(floor(p.value) AS BIGINT) % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'reading' WHEN 2 THEN 'paused' WHEN 3 THEN 'library' END AS shelf,
         p.at_ms AS shelf_at, v.at_ms AS pos_at, v.value AS pos, coalesce(c.value, 0) > 400 AS at_end, s.sec, s.last_day, f.finished
  FROM (SELECT DISTINCT user_id FROM w) u
  LEFT JOIN lww p ON p.user_id = u.user_id AND p.key = 'purchase'
  LEFT JOIN lww v ON v.user_id = u.user_id AND v.key = 'view'
  LEFT JOIN lww c ON c.user_id = u.user_id AND c.key = 'click'
  LEFT JOIN (SELECT user_id, round(sum(coalesce(value, 0)), 4) AS sec, max(day) AS last_day FROM w WHERE key IN ('view', 'click') GROUP BY 1) s ON s.user_id = u.user_id
  LEFT JOIN (SELECT user_id, max(day) AS finished FROM w WHERE key = 'signup' GROUP BY 1) f ON f.user_id = u.user_id
), s AS (
  SELECT *, CASE WHEN shelf = 'done' THEN 'done' WHEN shelf = 'reading' THEN 'reading'
                 WHEN shelf IN ('paused', 'library') THEN CASE WHEN coalesce(pos_at, 0) > coalesce(shelf_at, 0) THEN 'reading' ELSE 'paused' END
                 WHEN at_end THEN 'done' WHEN coalesce(sec, 0) > 600 THEN 'reading' ELSE 'none' END AS status FROM m
)
"""


def _merged(t: Tables) -> DataFrame:
    lww = st.last_writer_wins(_writes(t), ["user_id", "key"], "at_ms", ["device", "event_id"], ["value"])
    pivot = lww.groupBy("user_id").agg(
        F.max(F.when(F.col("key") == "purchase", F.col("value"))).alias("shelf_no"),
        F.max(F.when(F.col("key") == "purchase", F.col("at_ms"))).alias("shelf_at"),
        F.max(F.when(F.col("key") == "view", F.col("at_ms"))).alias("pos_at"),
        F.max(F.when(F.col("key") == "view", F.col("value"))).alias("pos"),
        F.max(F.when(F.col("key") == "click", F.col("value"))).alias("page"),
    )
    reading = F.col("key").isin("view", "click")
    own = _writes(t).groupBy("user_id").agg(
        F.round(F.sum(F.when(reading, F.coalesce("value", F.lit(0.0)))), 4).alias("sec"),
        F.max(F.when(reading, F.col("day"))).alias("last_day"),
        F.max(F.when(F.col("key") == "signup", F.col("day"))).alias("finished"),
    )
    shelf = F.get(F.array(*[F.lit(x) for x in ("done", "reading", "paused", "library")]), (F.floor("shelf_no") % 5).cast("int"))
    m = pivot.join(own, "user_id").withColumns({"shelf": shelf, "at_end": F.coalesce("page", F.lit(0.0)) > 400})
    return m.withColumn("status", st.status(F.col("shelf"), F.col("pos_at"), F.col("shelf_at"), F.col("at_end"), F.col("sec")))


@query(_MERGED + """
SELECT user_id, status, status = 'reading' AND finished IS NOT NULL AS rereading,
       CAST(CASE WHEN finished IS NOT NULL THEN finished WHEN status = 'done' THEN last_day END AS VARCHAR) AS finished_on FROM s
""")
def q_state_status(t: Tables) -> DataFrame:
    done_on = F.when(F.col("finished").isNotNull(), F.col("finished")).when(F.col("status") == "done", F.col("last_day"))
    return _merged(t).select(
        "user_id", "status", ((F.col("status") == "reading") & F.col("finished").isNotNull()).alias("rereading"), done_on.cast("string").alias("finished_on")
    )


@query(_MERGED + """
SELECT CAST(date_trunc('month', coalesce(finished, last_day)) AS DATE) AS month, count(*) AS n_done, min(user_id) AS first_user FROM s WHERE status = 'done' GROUP BY 1
""")
def q_last_finish(t: Tables) -> DataFrame:
    done = _merged(t).where("status = 'done'").withColumn("month", F.trunc(F.coalesce("finished", "last_day"), "month"))
    return done.groupBy("month").agg(F.count(F.lit(1)).alias("n_done"), F.min("user_id").alias("first_user"))


@query(_WRITES + """
, l AS (SELECT user_id, key, event_id % 2 AS copy, max_by({'v': value}, (at_ms, -event_id)).v AS value, max(at_ms) AS at_ms FROM w GROUP BY ALL),
a AS (SELECT * FROM l WHERE copy = 0), b AS (SELECT * FROM l WHERE copy = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.key, b.key) AS key,
       CASE WHEN a.at_ms IS NULL OR b.at_ms > a.at_ms THEN b.value ELSE a.value END AS value, greatest(a.at_ms, b.at_ms) AS at_ms
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.key = b.key
""")
def q_state_join_own(t: Tables) -> DataFrame:
    """All writes as two copies of one device's state, even and odd ones."""
    last = st.last_writer_wins(_writes(t).withColumn("copy", F.col("event_id") % 2), ["user_id", "key", "copy"], "at_ms", ["event_id"], ["value"])
    return st.join_own(last.where("copy = 0"), last.where("copy = 1"), ["user_id", "key"], "at_ms", "value")


@query(_WRITES + """
, d AS (SELECT user_id, CAST(day AS VARCHAR) AS day, event_id % 2 AS copy, round(sum(coalesce(value, 0)), 4) AS sec, count(*) AS words FROM w GROUP BY ALL),
a AS (SELECT * FROM d WHERE copy = 0), b AS (SELECT * FROM d WHERE copy = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, greatest(coalesce(a.sec, 0), coalesce(b.sec, 0)) AS sec, greatest(coalesce(a.words, 0), coalesce(b.words, 0)) AS words
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day
""")
def q_state_join_days(t: Tables) -> DataFrame:
    days = _writes(t).groupBy("user_id", F.col("day").cast("string").alias("day"), (F.col("event_id") % 2).alias("copy")).agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("sec"), F.count(F.lit(1)).alias("words"))
    return st.join_own_days(days.where("copy = 0"), days.where("copy = 1"), ["user_id", "day"], ["sec", "words"])


# Events are some seven hours apart; a clock 36 times as slow leaves minutes between them.
SLOW = 36
_SESSIONS = f"""
WITH s AS (SELECT user_id, event_id, make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // {SLOW}) AS ts FROM events), g AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM n GROUP BY user_id, s)
"""


def _ticks(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    return t.events.select("user_id", F.timestamp_micros(1_704_067_200_000_000 + F.floor(micros / SLOW)).cast("timestamp_ntz").alias("ts"))


@query(_SESSIONS + "SELECT * FROM sessions")
def q_sessions(t: Tables) -> DataFrame:
    return seq.sessions(_ticks(t), "user_id", "ts", 600)


@query(_SESSIONS + """
SELECT user_id, CAST(CAST(session_start AS DATE) AS VARCHAR) AS day, count(*) AS n_sessions,
       CAST(sum(epoch_us(session_end) // 1000 - epoch_us(session_start) // 1000) FILTER (WHERE session_end - session_start >= INTERVAL 2 SECOND) AS BIGINT) AS ms
FROM sessions GROUP BY ALL
""")
def q_session_days(t: Tables) -> DataFrame:
    s = seq.sessions(_ticks(t), "user_id", "ts", 600)
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    length = millis("session_end") - millis("session_start")
    micros = F.unix_micros(F.col("session_end").cast("timestamp")) - F.unix_micros(F.col("session_start").cast("timestamp"))
    return s.groupBy("user_id", F.col("session_start").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum(F.when(micros >= 2_000_000, length)).alias("ms"))


@query("""
SELECT event_id, user_id, prev, value FROM (
  SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events
) WHERE prev < 100 AND value >= 100 AND value - prev < 50
""")
def q_crossing(t: Tables) -> DataFrame:
    return seq.crossings(t.events, ["user_id"], ["ts", "event_id"], "value", 100, 50).select("event_id", "user_id", "prev", "value")


@query("""
SELECT user_id, count(*) FILTER (WHERE step > 0 AND step < 40) AS steps, round(coalesce(sum(step) FILTER (WHERE step > 0 AND step < 40), 0), 4) AS read FROM (
  SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events
) GROUP BY user_id
""")
def q_word_steps(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.when((F.col("step") > 0) & (F.col("step") < 40), F.col("step"))
    return t.events.withColumn("step", F.col("value") - F.lag("value").over(w)).groupBy("user_id").agg(F.count(step).alias("steps"), F.round(F.coalesce(F.sum(step), F.lit(0.0)), 4).alias("read"))


@query("""
WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, min_by(event_id, ts) AS first_view FROM v GROUP BY 1)
SELECT p.event_id, p.user_id, coalesce(v.event_id, f.first_view) AS place
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts LEFT JOIN f ON p.user_id = f.user_id
""")
def q_asof_place(t: Tables) -> DataFrame:
    views = t.events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("place"))
    asked = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return seq.asof(asked, views, ["user_id"], "ts", "ts", ["place"], first_if_none=True).select("event_id", "user_id", "place")


@query("""
SELECT event_id, user_id, epoch_us(nxt) // 1000 - epoch_us(ts) // 1000 AS ms_left FROM (
  SELECT *, min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events
) WHERE event_type = 'view'
""")
def q_unread_in_chapter(t: Tables) -> DataFrame:
    ahead = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).over(ahead)
    ms = F.unix_millis(F.col("nxt").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.withColumn("nxt", nxt).where("event_type = 'view'").select("event_id", "user_id", ms.alias("ms_left"))


@query(_MERGED + """
SELECT user_id, status, coalesce(status = 'reading' OR status = 'none' AND coalesce(pos_at, 0) > 0 AND least(1, pos / 400) > 0 AND least(1, pos / 400) < 0.99, false) AS current,
       row_number() OVER (PARTITION BY status ORDER BY coalesce(pos_at, 0) DESC, user_id) AS place FROM s
""")
def q_current(t: Tables) -> DataFrame:
    fraction = F.least(F.lit(1.0), F.col("pos") / 400)
    now = (F.col("status") == "reading") | ((F.col("status") == "none") & (F.coalesce("pos_at", F.lit(0)) > 0) & (fraction > 0) & (fraction < 0.99))
    w = Window.partitionBy("status").orderBy(F.desc(F.coalesce("pos_at", F.lit(0))), "user_id")
    return _merged(t).select("user_id", "status", F.coalesce(now, F.lit(False)).alias("current"), F.row_number().over(w).alias("place"))


@query(_MERGED + "SELECT user_id FROM s WHERE status = 'done' AND pos_at IS NOT NULL AND coalesce(finished, last_day) <= DATE '2024-01-24' AND user_id % 2 = 0")
def q_drop_copies(t: Tables) -> DataFrame:
    week_ago = F.date_sub(F.lit(TODAY).cast("date"), 7)
    local = F.col("user_id") % 2 == 0
    return _merged(t).where((F.col("status") == "done") & F.col("pos_at").isNotNull() & (F.coalesce("finished", "last_day") <= week_ago) & local).select("user_id")


@query(_STATS + """
SELECT user_id, sum(sec) AS sec, sum(words) AS words, sum(CASE WHEN day = DATE '2024-01-31' THEN sec ELSE 0 END) AS sec_today FROM stats GROUP BY 1
""")
def q_stats_totals(t: Tables) -> DataFrame:
    return _stats(t).groupBy("user_id").agg(F.sum("sec").alias("sec"), F.sum("words").alias("words"), F.sum(F.when(F.col("day") == TODAY, F.col("sec")).otherwise(0.0)).alias("sec_today"))


def half_even(x: str) -> str:
    """SQL for a double with three decimals, halves to the even digit, by its shortest decimal form."""
    v = f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)) * 1000"
    return f"CAST(floor({v}) + CASE WHEN {v} - floor({v}) > 0.5 OR {v} - floor({v}) = 0.5 AND floor({v}) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / 1000"


_WORDS_TIMED = """
WITH words AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS word, length(event_type) AS len,
         CASE WHEN event_id % 4 = 0 THEN round(epoch_us(ts) // 1000 / 1000.0 - 1704067200, 3) END AS t, round(epoch_us(ts) // 1000 / 1000.0 - 1704067200, 3) AS real_t FROM events
)
"""


def _timed_words(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.round(F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0 - 1704067200, 3)
    return t.events.select("user_id", (F.row_number().over(w) - 1).alias("word"), F.length("event_type").alias("len"), F.when(F.col("event_id") % 4 == 0, at).alias("t"), at.alias("real_t"))


@query(_WORDS_TIMED + """
, k AS (SELECT user_id, min(word) AS a, max(word) AS b, min(t) AS ta, max(t) AS tb FROM words WHERE t IS NOT NULL GROUP BY 1)
SELECT k.user_id, round((tb - ta) / coalesce(nullif(sum(CASE WHEN word >= a AND word < b THEN len + 1 ELSE 0 END), 0), 1), 6) AS rate FROM k JOIN words w ON w.user_id = k.user_id GROUP BY k.user_id, ta, tb
""")
def q_speaking_rate(t: Tables) -> DataFrame:
    words = _timed_words(t)
    ends = words.where("t is not null").groupBy("user_id").agg(F.min("word").alias("a"), F.max("word").alias("b"), F.min("t").alias("ta"), F.max("t").alias("tb"))
    inside = F.sum(F.when((F.col("word") >= F.col("a")) & (F.col("word") < F.col("b")), F.col("len") + 1).otherwise(0))
    return words.join(ends, "user_id").groupBy("user_id", "ta", "tb").agg(inside.alias("n")).select("user_id", F.round((F.col("tb") - F.col("ta")) / F.coalesce(F.nullif("n", F.lit(0)), F.lit(1)), 6).alias("rate"))


@query(_WORDS_TIMED + """
, b AS (SELECT *, sum(len + 1) OVER (PARTITION BY user_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0 FROM words),
c AS (SELECT *, coalesce(c0, 0) AS c FROM b),
n AS (
  SELECT *, last_value(t IGNORE NULLS) OVER u AS at0, last_value(CASE WHEN t IS NOT NULL THEN c END IGNORE NULLS) OVER u AS ac,
         first_value(t IGNORE NULLS) OVER f AS bt, first_value(CASE WHEN t IS NOT NULL THEN c END IGNORE NULLS) OVER f AS bc,
         first_value(t IGNORE NULLS) OVER p AS lo_t, first_value(CASE WHEN t IS NOT NULL THEN c END IGNORE NULLS) OVER p AS lo_c,
         last_value(t IGNORE NULLS) OVER p AS hi_t, last_value(CASE WHEN t IS NOT NULL THEN c END IGNORE NULLS) OVER p AS hi_c
  FROM c WINDOW u AS (PARTITION BY user_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                f AS (PARTITION BY user_id ORDER BY word ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                p AS (PARTITION BY user_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), r AS (
  SELECT *, (hi_t - lo_t) / CASE WHEN hi_c = lo_c THEN 1 ELSE hi_c - lo_c END AS rate FROM n WHERE lo_t IS NOT NULL
), s AS (
  SELECT user_id, word, CASE WHEN t IS NOT NULL THEN t WHEN at0 IS NULL THEN greatest(0, bt - (bc - c) * rate) WHEN bt IS NULL THEN least(2678400, at0 + (c - ac) * rate)
              ELSE at0 + (c - ac) * (bt - at0) / (bc - ac) END AS t0 FROM r
), e AS (SELECT *, least(coalesce(lead(t0) OVER (PARTITION BY user_id ORDER BY word), 2678400), t0 + 1.5) AS e FROM s)
SELECT user_id, word, """ + half_even("t0") + " AS t0, " + half_even("CASE WHEN e <= t0 THEN t0 + 0.05 ELSE e END") + " AS t1 FROM e")
def q_interpolate(t: Tables) -> DataFrame:
    return seq.interpolate(_timed_words(t), ["user_id"], "word", "t", F.col("len") + 1, F.lit(2678400.0)).select("user_id", "word", "t0", "t1")


@query(_WORDS_TIMED + """
SELECT user_id, word, value FROM (
  SELECT w.user_id, word, (word * 37) % 101 + word AS value, max((word * 37) % 101 + word) OVER (PARTITION BY user_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM words w
) WHERE m IS NULL OR value >= m
""")
def q_anchor_monotone(t: Tables) -> DataFrame:
    anchors = _timed_words(t).select("user_id", "word", ((F.col("word") * 37) % 101 + F.col("word")).alias("value"))
    return seq.running_max_only(anchors, ["user_id"], ["word"], "value")


@query(_WORDS_TIMED + """
SELECT user_id, word, round(least(coalesce(lead(real_t) OVER (PARTITION BY user_id ORDER BY word), real_t + 0.5), real_t + 2), 3) AS t_end FROM words
""")
def q_caption_ends(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("word")
    return _timed_words(t).select("user_id", "word", F.round(F.least(F.coalesce(F.lead("real_t").over(w), F.col("real_t") + 0.5), F.col("real_t") + 2), 3).alias("t_end"))


@query(_WORDS_TIMED + """
SELECT user_id, word, real_t AS t0, round(greatest(real_t + 0.05, least(coalesce(lead(real_t) OVER (PARTITION BY user_id ORDER BY word), 2678400), real_t + 1.5)), 3) AS t1 FROM words
""")
def q_time_clamp(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("word")
    end = F.least(F.coalesce(F.lead("real_t").over(w), F.lit(2678400.0)), F.col("real_t") + 1.5)
    return _timed_words(t).select("user_id", "word", F.col("real_t").alias("t0"), F.round(F.greatest(F.col("real_t") + 0.05, end), 3).alias("t1"))


# Every third word is found in the captions, some of them too late.
_ANCHORS = _WORDS_TIMED + """
, a AS (SELECT user_id, word, round(real_t + ((word * 37) % 101) * 1000, 3) AS t FROM words WHERE word % 3 = 0),
m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM a),
kept AS (SELECT * FROM m WHERE most IS NULL OR t >= most)
"""


def _anchors(t: Tables) -> DataFrame:
    found = _timed_words(t).where("word % 3 = 0").select("user_id", "word", F.round(F.col("real_t") + (F.col("word") * 37) % 101 * 1000, 3).alias("t"))
    return seq.running_max_only(found, ["user_id"], ["word"], "t")


@query(_ANCHORS + """
, h AS (SELECT user_id, string_agg(block || ':' || n, ',' ORDER BY block) AS hits FROM (SELECT user_id, word // 10 AS block, count(*) AS n FROM a GROUP BY ALL) GROUP BY 1),
c AS (SELECT user_id, count(*) AS n_words, max(real_t + 0.5) AS duration FROM words GROUP BY 1), k AS (SELECT user_id, count(*) AS n_anchors FROM kept GROUP BY 1), s AS (SELECT user_id, count(*) AS spoken FROM a GROUP BY 1)
SELECT c.user_id, n_words, n_anchors, spoken, round_even(n_anchors / greatest(n_words, 1), 4) AS coverage, round_even(n_anchors / greatest(spoken, 1), 4) AS match, hits, duration
FROM c JOIN k ON c.user_id = k.user_id JOIN s ON c.user_id = s.user_id JOIN h ON c.user_id = h.user_id
""")
def q_interpolate_pieces(t: Tables) -> DataFrame:
    """What is known of a text held against captions: anchors in order, shares, hits by block, duration."""
    found = _timed_words(t).where("word % 3 = 0")
    blocks = found.groupBy("user_id", F.floor(F.col("word") / 10).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    hits = blocks.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n"))), lambda x: F.concat_ws(":", x["block"].cast("string"), x["n"].cast("string"))), ",").alias("hits"))
    words = _timed_words(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_words"), F.max(F.col("real_t") + 0.5).alias("duration"), F.count_if(F.col("word") % 3 == 0).alias("spoken"))
    kept = _anchors(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_anchors"))
    ratio = lambda c: F.bround(F.col("n_anchors") / F.greatest(c, F.lit(1)), 4)
    return words.join(kept, "user_id").join(hits, "user_id").select("user_id", "n_words", "n_anchors", "spoken", ratio(F.col("n_words")).alias("coverage"), ratio(F.col("spoken")).alias("match"), "hits", "duration")


_FIXED = _WORDS_TIMED.replace("WITH words", "WITH RECURSIVE words") + """
, j AS (SELECT user_id, word, real_t + (word * 37) % 101 * 1000 AS t0, real_t FROM words),
fixed AS (
  SELECT user_id, word, t0, t0 AS fixed FROM j WHERE word = 0
  UNION ALL SELECT j.user_id, j.word, j.t0, CASE WHEN j.t0 < f.fixed THEN f.fixed + 0.01 ELSE j.t0 END FROM fixed f JOIN j ON j.user_id = f.user_id AND j.word = f.word + 1
)
"""


@query(_FIXED + "SELECT * FROM fixed")
def q_time_fix(t: Tables) -> DataFrame:
    words = _timed_words(t).select("user_id", "word", (F.col("real_t") + (F.col("word") * 37) % 101 * 1000).alias("t0"))
    return seq.fix_times(words, "user_id", "word", "t0")


@query(_FIXED.replace("word * 37) % 101 * 1000 AS t0", "word * 37) % 101 * (CASE WHEN word % 5 = 0 THEN 0 ELSE 1000 END) AS t0") + """
SELECT f.user_id, f.word, """ + half_even("f.fixed") + " AS t0, " + half_even("least(greatest(CASE WHEN f.word % 5 = 0 THEN j.real_t + 1 ELSE CASE WHEN f.word % 2 = 0 THEN f.t0 + 0.05 ELSE f.t0 + 0.4 END END, f.fixed + 0.05), coalesce(lead(f.fixed) OVER (PARTITION BY f.user_id ORDER BY f.word), 9000000.0), f.fixed + 1.5)") + """ AS t1
FROM fixed f JOIN j ON f.user_id = j.user_id AND f.word = j.word
""")
def q_aligned_times(t: Tables) -> DataFrame:
    """An aligner's times where it found a word (four of five), else those interpolated; in order and of sane length."""
    found = F.col("real_t") + (F.col("word") * 37) % 101 * 1000
    words = _timed_words(t).select(
        "user_id", "word", found.alias("found0"), F.when(F.col("word") % 2 == 0, found).otherwise(found + 0.4).alias("found1"), F.when(F.col("word") % 5 == 0, -9.0).otherwise(-1.0).alias("score"),
        F.col("real_t").alias("given0"), (F.col("real_t") + 1).alias("given1"),
    )
    return seq.aligned_times(words, ["user_id"], "word", F.lit(9_000_000.0))


# An hour of reading takes six seconds here, so that windows hold more than one word.
@query(_WORDS_TIMED.replace("WITH words", "WITH RECURSIVE words") + """
, a AS (SELECT user_id, word, real_t / 600 AS t, real_t / 600 + 0.5 AS e, max(word) OVER (PARTITION BY user_id) AS final FROM words),
nx AS (SELECT a.user_id, a.word, coalesce(min(b.word) FILTER (WHERE b.t - a.t >= 120 AND b.word < a.final), max(b.word)) AS nxt FROM a JOIN a b ON b.user_id = a.user_id AND b.word > a.word GROUP BY ALL),
chain AS (SELECT user_id, CAST(0 AS BIGINT) AS word, 0 AS window_no FROM nx WHERE word = 0 UNION ALL SELECT c.user_id, nx.nxt, c.window_no + 1 FROM chain c JOIN nx ON nx.user_id = c.user_id AND nx.word = c.word WHERE nx.nxt IN (SELECT word FROM nx n WHERE n.user_id = c.user_id))
SELECT c.user_id, c.window_no, c.word AS word_lo, CASE WHEN nx.nxt = z.final THEN nx.nxt ELSE nx.nxt - 1 END AS word_hi, x.t AS t_lo, CASE WHEN nx.nxt = z.final THEN least(4464.0, z.e + 5) ELSE z.t END AS t_hi
FROM chain c JOIN nx ON nx.user_id = c.user_id AND nx.word = c.word JOIN a x ON x.user_id = c.user_id AND x.word = c.word JOIN a z ON z.user_id = c.user_id AND z.word = nx.nxt
""")
def q_windows_120(t: Tables) -> DataFrame:
    words = _timed_words(t).select("user_id", "word", (F.col("real_t") / 600).alias("t0"), (F.col("real_t") / 600 + 0.5).alias("t1"))
    return seq.greedy_windows(words, "user_id", "word", "t0", "t1", F.lit(4464.0))


@query(_WRITES + """
, l AS (SELECT user_id, key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM w WHERE key <> 'error')
SELECT user_id, max(CASE WHEN key = 'error' THEN event_id END) AS last_exit, (SELECT string_agg(key, ',' ORDER BY event_id) FROM l WHERE l.user_id = w.user_id AND rn <= 6) AS tail,
       max_by(key, event_id) AS stage FROM w GROUP BY user_id
""")
def q_log_status(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    lines = _writes(t)
    tail = lines.where("key <> 'error'").withColumn("_rn", F.row_number().over(w)).where("_rn <= 6").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "key"))).alias("_t"))
    ends = lines.groupBy("user_id").agg(F.max(F.when(F.col("key") == "error", F.col("event_id"))).alias("last_exit"), F.max_by("key", "event_id").alias("stage"))
    text = F.array_join(F.transform("_t", lambda x: x["key"]), ",")
    return ends.join(tail, "user_id", "left").select("user_id", "last_exit", text.alias("tail"), "stage")


@query(_WRITES + """
, d AS (SELECT user_id, list(DISTINCT CAST(day AS VARCHAR)) AS days FROM w WHERE key = 'signup' GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_distinct(list_append(days, '2024-01-31'))), ',') AS added, array_to_string(list_sort(days)[:len(days) - 1], ',') AS without_last, list_max(days) AS last_day FROM d
""")
def q_finish_days(t: Tables) -> DataFrame:
    days = _writes(t).where("key = 'signup'").groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("day").cast("string"))).alias("days"))
    return days.select(
        "user_id",
        F.array_join(F.array_sort(F.array_union("days", F.array(F.lit(TODAY)))), ",").alias("added"),
        F.array_join(F.slice("days", F.lit(1), F.size("days") - 1), ",").alias("without_last"),
        F.array_max("days").alias("last_day"),
    )


@query(_WRITES + """
SELECT event_id, coalesce(CASE WHEN pct = 0 THEN NULL ELSE pct / 100 END >= 0.10, false) AS accepted, coalesce(CASE WHEN device = 0 THEN pct >= 99 ELSE value >= 400 - 60 END, false) AS at_end,
       round(least(1, CASE WHEN device = 0 THEN pct / 100 ELSE value / 400 END), 6) AS progress FROM w
""")
def q_accept(t: Tables) -> DataFrame:
    share = F.nullif("pct", F.lit(0.0)) / 100
    by_page = F.col("device") == 0
    return _writes(t).select(
        "event_id",
        F.coalesce(share >= 0.10, F.lit(False)).alias("accepted"),
        F.coalesce(F.when(by_page, F.col("pct") >= 99).otherwise(F.col("value") >= 400 - 60), F.lit(False)).alias("at_end"),
        F.round(F.least(F.lit(1.0), F.when(by_page, F.col("pct") / 100).otherwise(F.col("value") / 400)), 6).alias("progress"),
    )


_DAYS = _WRITES + """
SELECT event_id, CAST(day AS VARCHAR) AS utc_day, epoch_ms(CAST(day AS TIMESTAMP)) AS midnight_ms, isodow(day) AS weekday,
       CASE WHEN year(day) = 2024 THEN strftime(day, '%d.%m') ELSE strftime(day, '%d.%m.%Y') END AS label,
       CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 AS DOUBLE) AS clock, round_even(value / 10, 0) AS half_even, CAST(floor(value / 10 + 0.5) AS BIGINT) AS half_up,
       CAST(trunc(-value) AS INTEGER) AS truncated, replace(printf('%.1f', floor(round_even(value / 1000 * 1000, 6)) / 10), '.', ',') AS tenth,
       CAST(least(greatest(value, 50), 200) AS DOUBLE) AS clamped FROM w
"""


@query(_DAYS)
def q_days(t: Tables) -> DataFrame:
    w = _writes(t)
    clock = F.date_format("ts", "H:mm")
    return w.select(
        "event_id",
        F.col("day").cast("string").alias("utc_day"),
        F.unix_millis(F.col("day").cast("timestamp")).alias("midnight_ms"),
        (F.weekday("day") + 1).cast("long").alias("weekday"),
        F.when(F.year("day") == 2024, F.date_format("day", "dd.MM")).otherwise(F.date_format("day", "dd.MM.yyyy")).alias("label"),
        clock_seconds(F.concat(clock, F.lit(":00"))).alias("clock"),
        F.bround(F.col("value") / 10, 0).alias("half_even"),
        js_round(F.col("value") / 10).alias("half_up"),
        (-F.col("value")).cast("int").alias("truncated"),
        floor_to_tenth(F.col("value") / 1000).alias("tenth"),
        clamp(F.col("value"), F.lit(50.0), F.lit(200.0)).alias("clamped"),
    )


@query(_WRITES + """
SELECT event_id, CASE WHEN device = 0 THEN value WHEN device = 1 THEN CAST(least(greatest(CAST(trunc(value) AS INTEGER), 0), 99) // 2 AS DOUBLE) END AS sentence,
       array_to_string(list_transform([CAST(pct AS INTEGER), -1, 500], lambda x: list_transform(range(0, 100), lambda i: i // 2)[least(greatest(x, 0), 99) + 1]), ',') AS composed FROM w
""")
def q_translate_place(t: Tables) -> DataFrame:
    halves = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.floor(i / 2).cast("int"))
    edition = F.get(F.array(F.lit("now"), F.lit("old"), F.lit("lost")), F.col("device").cast("int"))
    maps = F.create_map(F.lit("old"), halves)
    composed = st.compose_map(F.array(F.col("pct").cast("int"), F.lit(-1), F.lit(500)), halves)
    return _writes(t).select("event_id", st.translate_place(F.col("value"), edition, F.lit("now"), maps).alias("sentence"), F.array_join(composed.cast("array<string>"), ",").alias("composed"))


# Each reader's book has a map for each device's edition: place k leads to the value of its k-th write.
_MAPS = _WRITES + """
, m AS (SELECT user_id, device, row_number() OVER (PARTITION BY user_id, device ORDER BY event_id) - 1 AS place, CAST(floor(value) AS BIGINT) % 50 AS value FROM w),
n AS (SELECT user_id, place, value FROM m WHERE device = 2), z AS (SELECT user_id, max(place) AS last FROM n GROUP BY 1),
led AS (SELECT m.user_id, 'e' || m.device AS edition, m.place, n.value FROM m JOIN z ON z.user_id = m.user_id JOIN n ON n.user_id = m.user_id AND n.place = least(greatest(m.value, 0), z.last))
"""


def _maps(t: Tables) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("user_id", "device").orderBy("event_id")
    rows = _writes(t).select("user_id", F.concat(F.lit("e"), F.col("device").cast("string")).alias("edition"), (F.row_number().over(w) - 1).cast("long").alias("place"), (F.floor("value") % 50).alias("value"))
    return rows.where("edition <> 'e2'"), rows.where("edition = 'e2'").drop("edition")


@query(_MAPS + "SELECT * FROM led WHERE edition <> 'e2'")
def q_compose_maps(t: Tables) -> DataFrame:
    older, newer = _maps(t)
    return st.compose_rows(older, newer, ["user_id"])


@query(_MAPS + "SELECT * FROM led WHERE edition NOT IN ('e1', 'e2') UNION ALL SELECT user_id, 'e1', place, value FROM n")
def q_compose_all(t: Tables) -> DataFrame:
    """All editions' maps after another extraction, which ``e1`` was the edition before."""
    older, newer = _maps(t)
    return st.lead_on(older, newer, ["user_id"], F.lit("e1"))


# A book's words are its reader's events, twelve to a block, five to a sentence; five hours are a second.
_PLACES = _MERGED + """
, k AS (SELECT user_id, max(at_ms) FILTER (WHERE key = 'click') AS sent_at FROM w GROUP BY 1),
words AS (SELECT user_id, word, (epoch_us(ts) // 1000 / 1000.0 - 1704067200) / 5000 AS t0, word // 12 AS block, word % 12 AS cs FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS word FROM events)),
sentences AS (SELECT user_id, word, row_number() OVER (PARTITION BY user_id ORDER BY word) - 1 AS number FROM words WHERE cs % 5 = 0),
z AS (SELECT user_id, count(*) AS n FROM sentences GROUP BY 1), f AS (SELECT user_id, min(word) AS word FROM words GROUP BY 1),
newer AS (SELECT s.user_id, s.pos, s.pos_at FROM s JOIN k ON k.user_id = s.user_id WHERE s.pos IS NOT NULL AND coalesce(s.pos_at, 0) > coalesce(k.sent_at, 0)),
heard AS (SELECT n.user_id, n.pos_at, coalesce(max(v.word), 0) AS word FROM newer n LEFT JOIN words v ON v.user_id = n.user_id AND v.t0 <= n.pos GROUP BY ALL),
kept AS (SELECT h.user_id, max(t.number) AS sent, h.pos_at AS sent_at, any_value(z.n) AS n FROM heard h JOIN sentences t ON t.user_id = h.user_id AND t.word <= h.word JOIN z ON z.user_id = h.user_id GROUP BY h.user_id, h.pos_at)
"""


def _kept_places(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    number = (F.row_number().over(w) - 1).cast("long")
    words = t.events.select("user_id", number.alias("word"), ((F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0 - 1704067200) / 5000).alias("t0")).withColumns({"block": F.floor(F.col("word") / 12), "cs": F.col("word") % 12})
    starts = Window.partitionBy("user_id").orderBy("word")
    sentences = words.where("cs % 5 = 0").select("user_id", "block", F.col("cs").alias("a"), (F.row_number().over(starts) - 1).cast("long").alias("number"))
    sent = _writes(t).groupBy("user_id").agg(F.max(F.when(F.col("key") == "click", F.col("at_ms"))).alias("sent_at"))
    states = _merged(t).select("user_id", "pos", "pos_at").join(sent, "user_id")
    return st.keep_place(states, words.select("user_id", "t0", "block", "cs"), sentences, ["user_id"])


@query(_PLACES + "SELECT user_id, sent, sent_at, CAST(round_even(sent / greatest(n, 1) * 100, 0) AS BIGINT) AS sent_pct FROM kept")
def q_keep_place(t: Tables) -> DataFrame:
    return _kept_places(t)


@query(_PLACES + "SELECT c.c_custkey, c.c_name, kept.sent AS kept_place FROM customer c LEFT JOIN kept ON kept.user_id = c.c_custkey")
def q_drop_columns(t: Tables) -> DataFrame:
    """Books without the columns of their audio, with the place that was being heard."""
    books = t.customer.drop("c_acctbal", "c_mktsegment", "c_nationkey")
    places = _kept_places(t).select(F.col("user_id").alias("c_custkey"), F.col("sent").alias("kept_place"))
    return books.select("c_custkey", "c_name").join(places, "c_custkey", "left")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'no audio' WHEN o_orderkey % 4 = 0 THEN 'unchanged' WHEN o_orderstatus = 'P' THEN 'refused: no captions' WHEN o_orderkey % 5 = 0 THEN 'refused: no audio file'
  WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'refused: no aligner' WHEN o_orderkey % 3 = 0 THEN 'rebuilt and aligned' ELSE 'rebuilt' END AS timing FROM orders
""")
def q_retime_reason(t: Tables) -> DataFrame:
    not_each = lambda n: F.col("o_orderkey") % n != 0
    decision = st.retiming(not_each(6), not_each(4), F.col("o_orderstatus") != "P", not_each(5), ~not_each(3), F.col("o_custkey") % 2 != 0)
    return t.orders.select("o_orderkey", decision.alias("timing"))


@query("""
WITH n AS (SELECT event_id FROM events WHERE event_id % 6 = 0)
SELECT user_id AS doc, count(*) AS lost FROM events WHERE event_id NOT IN (SELECT event_id FROM n) GROUP BY 1
""")
def q_lost_items(t: Tables) -> DataFrame:
    """What a new version of a collection has no more; it keeps every sixth item."""
    old = t.events.select(F.col("user_id").alias("doc"), "event_id")
    new = t.events.where("event_id % 6 = 0").select("event_id")
    return old.join(new, "event_id", "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("lost"))
