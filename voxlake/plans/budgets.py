"""Selections under a budget: rounds over ranges in Spark, a sequential walk in the oracle's SQL. Sizes are whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.dialect import Duck
from voxlake.functions.dialect import Spark as SparkDialect
from voxlake.operators.budget import budgeted
from voxlake.sources.places import stored

from .catalogue import PAIRS, UTTERANCES
from .folds import fold, keep
from .registry import query
from .sql import opened


def _micros(d) -> str:
    return f"SELECT channel, utt_id, CAST(round(duration * 1e6) AS bigint) AS micros FROM ({UTTERANCES}) u WHERE duration IS NOT NULL"


#: Half an hour of audio for each channel.
HALF_HOUR = 1_800_000_000
FITS = f"a.used + x.micros <= {HALF_HOUR}"


@query(fold(Duck(), "", _micros(Duck()), "channel", "micros DESC, utt_id", "utt_id micros", {"used": ("CAST(0 AS bigint)", keep(FITS, "a.used + x.micros", "a.used"))}, {"kept": FITS})
       + "\nSELECT g AS channel, utt_id, micros FROM folded WHERE kept")
def pack_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opened(spark, sf_dir, _micros(SparkDialect()))
    return budgeted(rows, "channel", [-F.col("micros"), F.col("utt_id")], "micros", F.lit(HALF_HOUR))


#: Pairs of a channel with their length in hundredths of a second.
LENGTHS = f"SELECT channel, session_id, pair_id, CAST(round(hours * 360000) AS bigint) AS ticks FROM ({PAIRS}) p"
CAP = 2_000 * 360_000
ADDS = f"a.used + x.ticks <= {CAP}"
OPEN = f"NOT a.done AND x.session_id <> a.shut AND {ADDS}"


@query(fold(Duck(), "", LENGTHS, "channel", "session_id, pair_id", "session_id pair_id ticks", {
    "used": ("CAST(0 AS bigint)", keep(OPEN, "a.used + x.ticks", "a.used")),
    "shut": ("CAST(-1 AS bigint)", keep(f"NOT a.done AND x.session_id <> a.shut AND NOT ({ADDS})", "x.session_id", "a.shut")),
    "done": ("false", f"a.done OR ({keep(OPEN, 'a.used + x.ticks', 'a.used')}) >= {CAP}")}, {"kept": OPEN})
    + "\nSELECT g AS channel, session_id, pair_id FROM folded WHERE kept")
def cap_with_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = budgeted(opened(spark, sf_dir, LENGTHS), "channel", [F.col("session_id"), F.col("pair_id")], "ticks", F.lit(CAP), unit="session_id")
    return kept.select("channel", "session_id", "pair_id")


def _largest(d) -> str:
    """Pairs of the channel with the most hours, with a budget that leaves it three tenths of all; each session's pairs in turn, by digest."""
    return f"""WITH p AS ({LENGTHS}), sums AS (SELECT channel, sum(ticks) AS ticks FROM p GROUP BY channel),
top AS (SELECT channel FROM (SELECT channel, row_number() OVER (ORDER BY ticks DESC, channel) AS r FROM sums) t WHERE r = 1),
least_ AS (SELECT CAST(floor(3 * sum(ticks) / 28) AS bigint) AS budget FROM sums WHERE channel NOT IN (SELECT channel FROM top))
SELECT p.channel, pair_id, ticks, budget, {d.sha('cast(session_id AS string)')} AS s, row_number() OVER (PARTITION BY session_id ORDER BY {d.sha('cast(pair_id AS string)')}) AS nth
FROM p JOIN top ON p.channel = top.channel CROSS JOIN least_"""


ROOM = "a.used + x.ticks <= x.budget"


@query(fold(Duck(), "", _largest(Duck()), "channel", "nth, s, pair_id", "pair_id ticks budget", {"used": ("CAST(0 AS bigint)", keep(ROOM, "a.used + x.ticks", "a.used"))}, {"kept": ROOM})
       + "\nSELECT g AS channel, pair_id FROM folded WHERE kept")
def session_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(opened(spark, sf_dir, _largest(SparkDialect())), "pairs")
    kept = budgeted(rows, "channel", [F.col("nth"), F.col("s"), F.col("pair_id")], "ticks", F.col("budget"))
    return kept.select("channel", "pair_id")


RESERVED = f"SELECT channel, session_id, sum(ticks) AS ticks, sum(CASE WHEN pair_id % 3 = 0 THEN ticks ELSE 0 END) AS gain FROM ({LENGTHS}) l GROUP BY channel, session_id"
#: Ticks of pairs that a channel's reserve should yield, and ticks of sessions that it may take.
TARGET, MOST = 4 * 100 * 360_000, 3_000 * 360_000
TAKES = f"a.got < {TARGET} AND a.used + x.ticks <= {MOST} AND x.gain > 0"


@query(fold(Duck(), "", f"SELECT *, sha256(session_id::VARCHAR) AS h FROM ({RESERVED}) s", "channel", "h, session_id", "session_id ticks gain", {
    "got": ("CAST(0 AS bigint)", keep(TAKES, "a.got + x.gain", "a.got")), "used": ("CAST(0 AS bigint)", keep(TAKES, "a.used + x.ticks", "a.used"))}, {"kept": TAKES})
    + "\nSELECT g AS channel, session_id, CAST(ticks AS bigint) AS ticks FROM folded WHERE kept")
def reserve_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opened(spark, sf_dir, RESERVED).where("gain > 0").withColumn("h", F.sha2(F.col("session_id").cast("string"), 256))
    kept = budgeted(stored(rows, "sessions"), "channel", [F.col("h"), F.col("session_id")], "ticks", F.lit(MOST), gain="gain", target=TARGET)
    return kept.select("channel", "session_id", "ticks")
