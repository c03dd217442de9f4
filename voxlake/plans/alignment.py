"""Joins of rows with decisions, and of intervals with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.dialect import Duck, Spark
from voxlake.operators.budget import placed

from .catalogue import PAIRS, binned, one_bin, segments
from .registry import query
from .sql import add, opened

# ---- decisions -----------------------------------------------------------------------------------

add("rights_strict", lambda d: """
SELECT channel, permission, used, known, known > 0 AND used > 0 AS matched, CASE WHEN known = 0 THEN 'undecided_channel' WHEN used = 0 THEN 'unknown_scope' ELSE 'ok' END AS verdict FROM (
  SELECT coalesce(w.channel, r.channel) AS channel, r.permission, coalesce(w.n, 0) AS used, CASE WHEN r.channel IS NULL THEN 0 ELSE 1 END AS known FROM (
    SELECT lang AS channel, count(*) AS n FROM documents GROUP BY lang) w FULL OUTER JOIN (
    SELECT CASE n_nationkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'xx' END AS channel, n_name AS permission FROM nation WHERE n_nationkey < 3) r ON w.channel = r.channel) x""")

add("review_upsert", lambda d: f"""
WITH old AS (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0), fresh AS (SELECT doc_id, 1 - quality AS quality FROM labels WHERE doc_id % 3 = 0),
r AS (SELECT doc_id, 1 AS nth, quality FROM old UNION ALL SELECT doc_id, 2, quality FROM fresh)
SELECT d.doc_id, count(r.nth) AS reviews, coalesce({d.arg_max('r.quality', 'r.nth')}, -1) AS verdict,
       coalesce({d.glued(d.gathered('cast(r.quality AS string)', 'r.nth'), ',') if d.name == 'spark' else "string_agg(r.quality::VARCHAR, ',' ORDER BY r.nth)"}, '') AS history
FROM documents d LEFT JOIN (SELECT doc_id, nth, max(quality) AS quality FROM r GROUP BY doc_id, nth) r ON d.doc_id = r.doc_id GROUP BY d.doc_id""")

CHOSEN = f"SELECT session_id, sum(hours) AS hours FROM ({PAIRS}) p WHERE session_id % 5 = 0 GROUP BY session_id"


def _windows(d, ranked: str) -> str:
    return f"""SELECT CAST(c.place AS bigint) AS place, c.session_id, count(*) AS windows, {d.glued(d.gathered('cast(p.pair_id AS string)', 'p.pair_id'), ',')} AS pair_ids
FROM {ranked} c JOIN ({PAIRS}) p ON p.session_id = c.session_id GROUP BY c.place, c.session_id"""


@query(_windows(Duck(), f"(SELECT session_id, row_number() OVER (ORDER BY round(hours, 6) DESC, session_id) AS place FROM ({CHOSEN}) x)"))
def ordered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all sessions come from sums over ranges, so no task sees every session."""
    rows = opened(spark, sf_dir, CHOSEN).select("session_id", (-F.round("hours", 6)).alias("less"))
    return opened(spark, sf_dir, _windows(Spark(), "{ranked}"), ranked=placed(rows, None, ["less", "session_id"]))


add("ratings_match", lambda d: """
WITH meta AS (SELECT doc_id AS session, lang AS speaker, n_chars % 3 AS age FROM documents),
rating AS (SELECT l.doc_id AS session, CASE WHEN l.doc_id % 10 = 0 THEN 'xx' ELSE d.lang END AS speaker, CASE WHEN l.doc_id % 7 = 0 THEN 9 ELSE d.n_chars % 3 END AS age, l.quality
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT r.session, max(r.quality) AS quality, count(*) AS n FROM rating r JOIN meta m ON r.session = m.session AND r.speaker = m.speaker AND r.age = m.age
WHERE m.speaker <> 'xx' GROUP BY r.session""")

add("panel_complete", lambda d: """
SELECT source, count(*) AS rows_, count(l.doc_id) AS predicted, count(*) = count(l.doc_id) AS complete
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""")

add("labels_complete", lambda d: """
WITH files AS (SELECT doc_id, 1 AS file, quality FROM labels UNION ALL SELECT doc_id, 2, toxic FROM labels WHERE doc_id % 2 = 0),
last AS (SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id ORDER BY file DESC, quality DESC) AS r FROM files) x WHERE r = 1)
SELECT s.doc_id, coalesce(last.quality, -1) AS quality, last.doc_id IS NOT NULL AS labelled, c.complete
FROM documents s LEFT JOIN last ON s.doc_id = last.doc_id
CROSS JOIN (SELECT count(*) = 0 AS complete FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) c""")

add("verdict_agreement", lambda d: """
SELECT e.doc_id, e.label FROM (SELECT doc_id, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS label FROM documents) e
JOIN (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id) v ON e.doc_id = v.doc_id AND e.label = v.label""")

add("latest_snapshot", lambda d: """
SELECT e.event_id, s.level FROM events e JOIN (
  SELECT k, level FROM (SELECT round(value, 0) AS k, value AS level, row_number() OVER (PARTITION BY round(value, 0) ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1) s
ON round(e.value, 0) = s.k""")

add("tree_reconcile", lambda d: f"""
WITH declared AS (SELECT url AS path, length(html) AS bytes, md5(html) AS digest FROM pages WHERE page_id % 10 <> 1),
actual AS (SELECT url AS path, length(html) + CASE WHEN page_id % 10 = 2 THEN 1 ELSE 0 END AS bytes, md5(CASE WHEN page_id % 10 = 3 THEN '' ELSE html END) AS digest FROM pages WHERE page_id % 10 <> 0)
SELECT {d.count_if('a.path IS NULL')} AS missing, {d.count_if('x.path IS NULL')} AS extra, {d.count_if('a.bytes <> x.bytes')} AS other_bytes, {d.count_if('a.digest <> x.digest')} AS other_digest,
       coalesce(bool_and(coalesce(a.bytes = x.bytes AND a.digest = x.digest, false)), true) AS exact FROM declared x FULL OUTER JOIN actual a ON x.path = a.path""")

# ---- intervals -----------------------------------------------------------------------------------

#: Captions: the segments shifted and shortened; raw turns stay as they are.
CAPTIONS = "cap AS (SELECT conv_id, turn, speaker, start + 0.3e0 AS start, start + 0.3e0 + 0.8e0 * (stop - start) AS stop FROM seg WHERE stop > start)"
OVERLAP = "least(c.stop, t.stop) - greatest(c.start, t.start)"

add("caption_alignment", lambda d: f"""
WITH {segments(d)}, {CAPTIONS}, o AS (
  SELECT c.conv_id, c.turn, c.start, c.stop, t.speaker, sum({OVERLAP}) AS seconds, min(t.turn) AS first FROM {binned(d, 'cap')} c JOIN {binned(d, 'seg')} t
  ON c.conv_id = t.conv_id{one_bin(d, 'c', 't')} AND t.start < c.stop AND c.start < t.stop GROUP BY c.conv_id, c.turn, c.start, c.stop, t.speaker),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(seconds, 9) DESC, first) AS r FROM o)
SELECT c.conv_id, c.turn, r.speaker AS best_speaker, round(coalesce(r.seconds, 0e0) / (c.stop - c.start), 4) AS confidence
FROM cap c LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn AND r.r = 1""")

RATIO = "greatest(0e0, {}) / least(c.stop - c.start, t.stop - t.start)".format(OVERLAP)


def matched(d) -> str:
    """Raw turns that match a caption's speaker and cover half of the shorter one."""
    return f"""m AS (SELECT c.conv_id, c.turn, c.start, c.stop, t.turn AS raw, t.start AS raw_start, t.stop AS raw_stop, {RATIO} AS ratio FROM {binned(d, 'cap')} c JOIN {binned(d, 'seg')} t
  ON c.conv_id = t.conv_id{one_bin(d, 'c', 't')} AND c.speaker = t.speaker AND t.stop > t.start AND t.start < c.stop AND c.start < t.stop WHERE {RATIO} >= 0.5e0)"""


NEXT = """p AS (SELECT conv_id, turn, speaker, start, stop, lead(turn) OVER w AS next_turn, lead(speaker) OVER w AS next_speaker, lead(start) OVER w AS next_start
  FROM cap WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn))"""

add("raw_turn_match", lambda d: f"""
WITH {segments(d)}, {CAPTIONS}, {matched(d)}, {NEXT}, c AS (
  SELECT p.conv_id, p.turn, round(least(u.raw_stop, a.raw_stop) - greatest(u.raw_start, a.raw_start), 9) AS overlap, round(least(u.ratio, a.ratio), 9) AS matched,
         u.raw_start, u.raw_stop, a.raw_start AS response_start, a.raw_stop AS response_stop
  FROM p JOIN m u ON u.conv_id = p.conv_id AND u.turn = p.turn AND u.raw_stop >= p.stop - 0.5e0
  JOIN m a ON a.conv_id = p.conv_id AND a.turn = p.next_turn AND a.raw_start <= p.next_start + 0.5e0
  WHERE p.speaker <> p.next_speaker AND a.raw_start > u.raw_start AND least(u.raw_stop, a.raw_stop) - greatest(u.raw_start, a.raw_start) >= 0.2e0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, matched DESC, raw_start DESC, raw_stop DESC, response_start DESC, response_stop DESC) AS r FROM c)
SELECT conv_id, turn, round(overlap, 6) AS overlap_seconds, round(matched, 6) AS matched, round(raw_start, 6) AS raw_start, round(response_stop, 6) AS response_stop FROM r WHERE r = 1""")

add("clean_turn_onset", lambda d: f"""
WITH {segments(d)}, {CAPTIONS}, {matched(d)}, {NEXT}, c AS (
  SELECT p.conv_id, p.turn, round(least(u.ratio, a.ratio), 9) AS matched, round(a.raw_start - u.raw_stop, 9) AS gap, a.raw_start AS onset
  FROM p JOIN m u ON u.conv_id = p.conv_id AND u.turn = p.turn AND abs(u.raw_stop - p.stop) <= 20
  JOIN m a ON a.conv_id = p.conv_id AND a.turn = p.next_turn AND abs(a.raw_start - p.next_start) <= 0.5e0
  WHERE p.speaker <> p.next_speaker AND a.raw_start - u.raw_stop BETWEEN 0.2e0 AND 2e0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY matched DESC, gap, onset DESC) AS r FROM c)
SELECT conv_id, turn, round(onset, 6) AS onset, gap FROM r WHERE r = 1""")

add("boundary_overlaps", lambda d: f"""
WITH {segments(d)}, o AS (
  SELECT a.conv_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM {binned(d, 'seg')} a JOIN {binned(d, 'seg')} b
  ON a.conv_id = b.conv_id{one_bin(d, 'a', 'b')} AND a.turn < b.turn AND a.speaker <> b.speaker AND a.start < b.stop AND b.start < a.stop)
SELECT s.conv_id, s.turn, count(o.start) > 0 AS near_overlap FROM {binned(d, 'seg', 'stop - 0.5e0', 'stop + 0.5e0')} s LEFT JOIN {binned(d, 'o')} o ON s.conv_id = o.conv_id{'' if d.name == 'duck' else ' AND s.bin = o.bin'} AND o.start < s.stop + 0.5e0 AND o.stop > s.stop - 0.5e0
GROUP BY s.conv_id, s.turn""")

add("interval_complement", lambda d: f"""
WITH {segments(d)}, s AS (SELECT conv_id, turn, greatest(0e0, start) AS start, least(stop, total) AS stop, total FROM (
  SELECT *, max(stop) OVER (PARTITION BY conv_id) + conv_id % 3 AS total FROM seg) x WHERE least(stop, total) > greatest(0e0, start)),
g AS (SELECT conv_id, start, coalesce(max(stop) OVER (PARTITION BY conv_id ORDER BY start, stop, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS covered FROM s)
SELECT conv_id, round(covered, 6) AS gap_start, round(start, 6) AS gap_stop FROM g WHERE start > covered
UNION ALL SELECT conv_id, round(max(stop), 6), round(max(total), 6) FROM s GROUP BY conv_id HAVING max(stop) < max(total)""")

add("turn_end_examples", lambda d: f"""
WITH {segments(d)}, n AS (SELECT conv_id, turn, start, stop, lead(start) OVER (PARTITION BY conv_id ORDER BY start, stop, turn) AS following FROM seg)
SELECT n.conv_id, n.turn, round(n.stop, 6) AS ends FROM n WHERE n.stop - n.start >= 1.5e0 AND n.following >= n.stop + 0.2e0 AND NOT EXISTS (
  SELECT 1 FROM seg a JOIN seg b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.speaker <> b.speaker AND a.start < b.stop AND b.start < a.stop
  WHERE a.conv_id = n.conv_id AND greatest(a.start, b.start) < n.stop AND least(a.stop, b.stop) > n.stop - 1)""" if d.name == "duck" else f"""
WITH {segments(d)}, n AS (SELECT conv_id, turn, start, stop, lead(start) OVER (PARTITION BY conv_id ORDER BY start, stop, turn) AS following FROM seg),
o AS (SELECT a.conv_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM {binned(d, 'seg')} a JOIN {binned(d, 'seg')} b
  ON a.conv_id = b.conv_id{one_bin(d, 'a', 'b')} AND a.turn < b.turn AND a.speaker <> b.speaker AND a.start < b.stop AND b.start < a.stop)
SELECT n.conv_id, n.turn, round(n.stop, 6) AS ends FROM n LEFT ANTI JOIN o ON n.conv_id = o.conv_id AND o.start < n.stop AND o.stop > n.stop - 1
WHERE n.stop - n.start >= 1.5e0 AND n.following >= n.stop + 0.2e0""")

add("stereo_offsets", lambda d: f"""
WITH {segments(d)}, n AS (SELECT conv_id, turn, speaker, start, stop, lead(speaker) OVER w AS other, lead(start) OVER w AS other_start, lead(stop) OVER w AS other_stop
  FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn))
SELECT conv_id, turn, CAST(round((start - least(start, other_start)) * 16000) AS bigint) AS left_from, CAST(round((stop - least(start, other_start)) * 16000) AS bigint) AS left_to,
       CAST(round((other_start - least(start, other_start)) * 16000) AS bigint) AS right_from, CAST(round((other_stop - least(start, other_start)) * 16000) AS bigint) AS right_to
FROM n WHERE other <> speaker""")

# ---- sets of ids ---------------------------------------------------------------------------------

add("disjoint_union", lambda d: f"""
WITH u AS (SELECT doc_id, 'a' AS manifest FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id % 3 = 1 OR doc_id % 30 = 0)
SELECT count(*) AS rows_, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT doc_id) AS duplicates, count(*) = count(DISTINCT doc_id) AS disjoint FROM u""")
add("common_ids", lambda d: "SELECT doc_id FROM documents WHERE n_chars > 500 INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
add("split_disjointness", lambda d: f"""
SELECT grain, {d.count_if('splits > 1')} AS shared, {d.count_if('splits > 1')} = 0 AS disjoint FROM (
  SELECT 'source' AS grain, source AS k, count(DISTINCT doc_id % 10 = 0) AS splits FROM documents GROUP BY source
  UNION ALL SELECT 'doc', cast(doc_id AS string), count(DISTINCT doc_id % 10 = 0) FROM documents GROUP BY doc_id) x GROUP BY grain""")
add("subset_test", lambda d: """
SELECT count(*) AS outside, count(*) = 0 AS subset FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) x""")
add("resumed_manifest", lambda d: """
WITH done AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT part, count(*) AS n, CAST(sum(n_chars) AS bigint) AS chars FROM (
  SELECT 'kept' AS part, d.doc_id, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM done)
  UNION ALL SELECT 'added', d.doc_id, d.n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM done) x ON d.doc_id = x.doc_id WHERE x.doc_id IS NULL) u GROUP BY part""")
