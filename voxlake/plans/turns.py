"""Streams with lists and timers in their state, and streams joined with streams; each equals SQL that walks or joins the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.dialect import Duck
from voxlake.streaming import turns

from .folds import fold, keep
from .registry import query
from .streams import frames, landed, replay

# ---- turns ------------------------------------------------------------------------------------------

#: A session of a user is over after a day and a half without rows.
GAP_MS = 36 * 3_600_000
DELAY_MS = 3_600_000


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event is a verdict on a pause, every fifth a result of the run that a pause starts; the others are frames."""
    rows = frames(spark, sf_dir).withColumns({
        "kind": F.expr("CASE seq % 5 WHEN 3 THEN 'verdict' WHEN 4 THEN 'result' ELSE 'frame' END"),
        "unfinished": F.expr("seq % 2 = 0"),
    })
    stream = replay(rows, "unix_micros(ts)").withWatermark("ts", f"{DELAY_MS} milliseconds")
    return landed(turns.turns(stream, turns.Limits(), GAP_MS))


FRAME = "x.kind = 'frame'"
START = f"{FRAME} AND NOT a.talks AND x.p >= 0.5e0 AND a.voiced + 1 >= 2"
HIGH, LOW = f"{FRAME} AND a.talks AND x.p >= 0.35e0", f"{FRAME} AND a.talks AND x.p < 0.35e0"
LONG = "a.heard - a.began + 1 >= 2"
PAUSE = f"{LOW} AND NOT a.paused AND {LONG} AND a.silent + 1 BETWEEN 1 AND 2"
CLOSE = f"{LOW} AND a.silent + 1 >= greatest(3, a.hold)"
VERDICT = "x.kind = 'verdict'"
TALKS = f"(a.talks AND NOT ({CLOSE})) OR ({START})"
NO = "CAST([] AS BIGINT[])"
KEEPS = f"CASE WHEN {CLOSE} OR {HIGH} THEN {NO} WHEN x.kind = 'result' AND a.paused THEN list_append(a.held, x.event_id) ELSE a.held END"

#: Sessions are parted by their gaps first; the walk then follows one session.
WALK = fold(
    Duck(),
    f"""e AS (SELECT user_id, event_id, value / 100e0 AS p, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us,
  CASE event_id % 5 WHEN 3 THEN 'verdict' WHEN 4 THEN 'result' ELSE 'frame' END AS kind, event_id % 2 = 0 AS unfinished FROM events),
parted AS (SELECT *, CASE WHEN ms > lag(ms) OVER (PARTITION BY user_id ORDER BY us, event_id) + {GAP_MS} THEN 1 ELSE 0 END AS cut FROM e),
sess AS (SELECT *, user_id * 100000 + sum(cut) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM parted)""",
    "SELECT * FROM sess", "session", "us, event_id", "user_id event_id ms p kind unfinished",
    {
        "frames": ("CAST(0 AS bigint)", keep(FRAME, "a.frames + 1", "a.frames")),
        "talks": ("false", TALKS),
        "voiced": ("CAST(0 AS bigint)", f"CASE WHEN NOT {FRAME} THEN a.voiced WHEN {CLOSE} THEN 0 WHEN a.talks THEN a.voiced WHEN x.p >= 0.5e0 THEN a.voiced + 1 ELSE 0 END"),
        "silent": ("CAST(0 AS bigint)", f"CASE WHEN {START} OR {HIGH} THEN 0 WHEN {LOW} THEN a.silent + 1 ELSE a.silent END"),
        "began": ("CAST(0 AS bigint)", keep(START, "a.frames", "a.began")),
        "heard": ("CAST(0 AS bigint)", keep(f"{START} OR {HIGH}", "a.frames + 1", "a.heard")),
        "paused": ("false", f"CASE WHEN {PAUSE} THEN true WHEN {HIGH} OR {CLOSE} THEN false ELSE a.paused END"),
        "hold": ("CAST(0 AS bigint)", f"CASE WHEN {HIGH} OR {CLOSE} THEN 0 WHEN {VERDICT} AND a.paused AND x.unfinished THEN 5 ELSE a.hold END"),
        "gate": ("false", f"CASE WHEN {CLOSE} THEN {LONG} WHEN {START} THEN false ELSE a.gate END"),
        "held": (NO, KEEPS),
    },
    {
        "event": f"""CAST(CASE WHEN {START} THEN 'speech_start' WHEN {PAUSE} THEN 'speech_pause' WHEN {HIGH} AND a.paused THEN 'speech_resume'
          WHEN {CLOSE} THEN CASE WHEN {LONG} THEN 'speech_end' ELSE 'drop' END
          WHEN {VERDICT} THEN CASE WHEN NOT a.paused THEN 'late' WHEN x.unfinished THEN 'held' ELSE 'complete' END
          WHEN x.kind = 'result' AND NOT a.paused THEN CASE WHEN a.gate THEN 'sent' ELSE 'discarded' END END AS string)""",
        "fate": f"CAST(CASE WHEN {CLOSE} THEN 'released' WHEN {HIGH} THEN 'discarded' END AS string)",
        "let": f"CAST(CASE WHEN {CLOSE} OR {HIGH} THEN a.held ELSE {NO} END AS BIGINT[])",
        "still": f"CAST({TALKS} AS boolean)",
        "rest": f"CAST({KEEPS} AS BIGINT[])",
    },
) + f""",
last AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r DESC) AS back FROM folded),
shut AS (SELECT * FROM last WHERE back = 1 AND (ms + {GAP_MS} <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - {DELAY_MS}
  OR g NOT IN (SELECT max(g) FROM folded GROUP BY user_id))),
rows_ AS (SELECT user_id, event_id, event, event_id AS decided, 0 AS place FROM folded WHERE event IS NOT NULL
  UNION ALL SELECT user_id, unnest(let), fate, event_id, unnest(range(1, len(let) + 1)) FROM folded WHERE len(let) > 0
  UNION ALL SELECT user_id, event_id, 'disconnected', event_id, 0 FROM shut WHERE still
  UNION ALL SELECT user_id, unnest(rest), 'discarded', event_id, unnest(range(1, len(rest) + 1)) FROM shut WHERE len(rest) > 0)
SELECT user_id, event_id, event, CAST(decided AS bigint) AS decided, CAST(place AS bigint) AS place FROM rows_ WHERE event IN """

HOLDS = "('speech_start', 'speech_pause', 'speech_resume', 'speech_end', 'drop', 'held', 'complete', 'late')"
RESULTS = "('released', 'discarded', 'sent')"
OPEN = "('disconnected')"


def _named(found: DataFrame, events: str) -> DataFrame:
    return found.where(f"event IN {events}").select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "event", "decided", "place")


@query(WALK + HOLDS)
def stream_turn_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_turns(spark, sf_dir), HOLDS)


@query(WALK + RESULTS)
def stream_held_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_turns(spark, sf_dir), RESULTS)


@query(WALK + OPEN)
def stream_disconnects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_turns(spark, sf_dir), OPEN)


# ---- retention --------------------------------------------------------------------------------------


@query("""SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS greatest, round(sum(value) OVER w, 4) AS total FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def stream_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = replay(frames(spark, sf_dir), "unix_micros(ts)").withWatermark("ts", "1 hour")
    found = landed(turns.trailing(stream, 86_400_000_000))
    return found.select(F.col("seq").alias("event_id"), "n", "greatest", F.round("total", 4).alias("total"))


# ---- clauses ----------------------------------------------------------------------------------------

DELTA = 7
UNITS = r"[^\s.!?؟،؛:]*[\s.!?؟،؛:]|[^\s.!?؟،؛:]+$"
HAS = r"regexp_matches(x.u, '^[^\s]')"
WORDS = f"(a.words + CASE WHEN {HAS} AND NOT a.inside THEN 1 ELSE 0 END)"
FULL = rf"(CASE WHEN regexp_matches(x.u, '[.!?؟،؛:\n]$') THEN {WORDS} >= CASE WHEN a.given = 0 THEN 3 ELSE 1 END ELSE false END OR CASE WHEN regexp_matches(x.u, '\s$') THEN {WORDS} >= CASE WHEN a.given = 0 THEN 7 ELSE 14 END ELSE false END)"
CLAUSES = fold(
    Duck(), "", rf"SELECT conv_id * 1000 + turn AS reply, i, us[i] AS u FROM (SELECT conv_id, turn, regexp_extract_all(text, '{UNITS}') AS us FROM conversations WHERE text IS NOT NULL) t, unnest(range(1, len(us) + 1)) AS n(i)",
    "reply", "i", "u",
    {"words": ("CAST(0 AS bigint)", f"CASE WHEN {FULL} THEN 0 ELSE {WORDS} END"),
     "inside": ("false", rf"CASE WHEN {FULL} OR regexp_matches(x.u, '\s$') THEN false ELSE a.inside OR {HAS} END"),
     "given": ("CAST(0 AS bigint)", keep(FULL, "a.given + 1", "a.given"))},
    {"place": "CAST(a.given AS bigint)"}) + """
SELECT g // 1000 AS conv_id, g % 1000 AS turn, place + 1 AS place, trim(string_agg(u, '' ORDER BY r), ' \t\n\r') AS clause FROM folded GROUP BY g, place
HAVING trim(string_agg(u, '' ORDER BY r), ' \t\n\r') <> ''"""


@query(CLAUSES)
def stream_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts arrive in deltas of a few characters, dealt over micro-batches; the clauses are those of the whole texts."""
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").withColumn("n", F.expr(f"greatest(1, CAST(ceil(length(text) / {DELTA}) AS int))"))
    deltas = texts.select(F.col("conv_id").alias("key"), F.col("turn").alias("reply"), "n", "text", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    deltas = deltas.select(
        "key", "reply", F.col("i").cast("long").alias("seq"), F.expr(f"substring(text, {DELTA} * i + 1, {DELTA})").alias("delta"),
        (F.col("i") + 1 == F.col("n")).alias("last"), F.timestamp_seconds(F.col("i") + 86_400).alias("ts"),
    )
    found = landed(turns.clauses(replay(deltas).withWatermark("ts", "1 hour")))
    return found.select(F.col("key").alias("conv_id"), F.col("reply").alias("turn"), "place", "clause")


# ---- microphone and playback ------------------------------------------------------------------------

#: A playback frame belongs to the microphone frame of its session and position if they are at most so far apart.
APART = 100
LATE_MINUTES = 300


def _minutes(column: str, by: str) -> str:
    return f"{column} + make_dt_interval(0, 0, {by})"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphone frames with the playback level of their position, null where none came in time: two streams, both watermarked.

    Frames arrive out of order, up to two hours late; both sides wait for LATE_MINUTES.
    """
    rows = frames(spark, sf_dir)
    mic = rows.where("seq % 2 = 0").select("key", F.expr("seq div 2").alias("pos"), "ts", F.col("value").alias("level"), (F.expr("unix_micros(ts)") + F.expr("seq % 11 * 720000000")).alias("arrival"))
    play = rows.where("seq % 3 <> 0").select(
        F.col("key").alias("of"), F.expr("seq div 2").alias("at"), F.expr(_minutes("ts", "(seq % 7 - 3) * 40")).alias("played"), F.col("value").alias("reference"),
        (F.expr("unix_micros(ts)") + F.expr("seq % 5 * 1440000000")).alias("arrival"),
    )
    left = replay(mic, "arrival").drop("arrival").withWatermark("ts", f"{LATE_MINUTES} minutes")
    right = replay(play, "arrival").drop("arrival").withWatermark("played", f"{LATE_MINUTES} minutes")
    near = F.expr(f"key = of AND pos = at AND played BETWEEN ts - INTERVAL {APART} MINUTES AND ts + INTERVAL {APART} MINUTES")
    return landed(left.join(right, near, "left_outer").select("key", "pos", "ts", "level", "reference"))


@query(f"""WITH mic AS (SELECT user_id, event_id // 2 AS pos, ts, value AS level FROM events WHERE event_id % 2 = 0),
play AS (SELECT user_id, event_id // 2 AS pos, ts + to_minutes((event_id % 7 - 3) * 40) AS played, value AS reference FROM events WHERE event_id % 3 <> 0),
wm AS (SELECT least((SELECT max(ts) FROM mic), (SELECT max(played) FROM play)) - INTERVAL {LATE_MINUTES} MINUTE AS t)
SELECT m.user_id, m.pos, m.level, p.reference FROM mic m LEFT JOIN play p ON p.user_id = m.user_id AND p.pos = m.pos
  AND p.played BETWEEN m.ts - INTERVAL {APART} MINUTE AND m.ts + INTERVAL {APART} MINUTE
WHERE p.pos IS NOT NULL OR m.ts + INTERVAL {APART} MINUTE < (SELECT t FROM wm)""")
def stream_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = references(spark, sf_dir)
    return found.select(F.col("key").alias("user_id"), "pos", "level", "reference")
