"""Audits, reports and gates over manifests, windows, reviews and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.dialect import Duck, Spark
from voxlake.operators.budget import placed

from .catalogue import PAIRS, UTTERANCES, segments, utt_split
from .predicates import NOISE
from .registry import query
from .sql import add, opened

# ---- manifests -----------------------------------------------------------------------------------

add("split_summary", lambda d: f"""
SELECT split, count(*) AS n, count(DISTINCT session_id) AS sessions, {d.distinct_sorted('channel')} AS channels, round(sum(duration) / 3600, 6) AS hours
FROM ({utt_split(d)}) s GROUP BY split""")

#: A merged manifest with blank, repeated and leaking rows.
MERGED = """SELECT doc_id AS pos, CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 37 = 0 THEN 'u-0' ELSE concat('u-', cast(doc_id AS string)) END AS utt_id,
  CASE WHEN doc_id % 41 = 0 THEN '' ELSE source END AS session_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'unspecified' ELSE 'train' END AS split,
  CASE WHEN doc_id % 43 = 0 THEN -1e0 ELSE n_chars / 150e0 END AS duration, lang AS channel, text FROM documents"""
add("merge_report", lambda d: f"""
SELECT pos, {d.glued(d.filter(d.array("CASE WHEN utt_id = '' THEN 'blank_id' END", "CASE WHEN r > 1 THEN 'duplicate_id' END", "CASE WHEN session_id = '' THEN 'blank_session' END", "CASE WHEN duration < 0 THEN 'negative_duration' END"), 'w IS NOT NULL'), ',')} AS reasons,
       r = 1 AND utt_id <> '' AND session_id <> '' AND duration >= 0 AS merged FROM (
  SELECT m.*, CASE WHEN m.pos > f.first THEN 2 ELSE 1 END AS r FROM ({MERGED}) m JOIN (SELECT utt_id, min(pos) AS first FROM ({MERGED}) m0 GROUP BY utt_id) f ON m.utt_id = f.utt_id) x""")
add("manifest_counts", lambda d: f"""
SELECT split, count(*) AS n, round(sum(CASE WHEN duration >= 0 THEN duration ELSE 0e0 END) / 3600, 6) AS hours, {d.count_if('duration < 0')} AS schema_errors,
       count(*) - count(DISTINCT utt_id) AS duplicate_ids, {d.count_if("channel = 'en'")} AS label_en, {d.count_if("channel = 'de'")} AS label_de,
       CAST(sum(leak) AS bigint) AS leaking_rows FROM (
  SELECT m.*, CASE WHEN g.splits > 1 THEN 1 ELSE 0 END AS leak FROM ({MERGED}) m JOIN (
    SELECT session_id, count(DISTINCT CASE WHEN split <> 'unspecified' THEN split END) AS splits FROM ({MERGED}) m0 GROUP BY session_id) g ON m.session_id = g.session_id) x GROUP BY split""")

add("selection_gates", lambda d: f"""
WITH c AS (SELECT channel, sum(hours) AS hours, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ({PAIRS}) p GROUP BY channel)
SELECT round(sum(hours), 4) AS hours, sum(hours) >= 100 AS enough, sum(hours) <= 1e9 AS not_too_much, max(hours) <= 0.55e0 * sum(hours) AS share_ok, bool_and(n > 0) AS all_present,
       min(sessions) >= 5 AS sessions_ok, count(*) >= 4 AS channels_ok,
       sum(hours) >= 100 AND max(hours) <= 0.55e0 * sum(hours) AND bool_and(n > 0) AND min(sessions) >= 5 AND count(*) >= 4 AS passed FROM c""")

add("strata_coverage", lambda d: f"""
SELECT channel, eligible, reviewed, eligible = covered AS complete FROM (
  SELECT e.channel, count(*) AS eligible, count(r.noise) AS covered, coalesce(max(r.n), 0) AS reviewed FROM (SELECT channel, {NOISE} AS noise FROM (
      SELECT channel, hours / 2 AS snr FROM ({PAIRS}) p) q GROUP BY channel, {NOISE}) e LEFT JOIN (
    SELECT channel, {NOISE} AS noise, count(*) AS n FROM (SELECT channel, hours / 2 AS snr FROM ({PAIRS}) p WHERE pair_id % 50 = 0) q GROUP BY channel, {NOISE}) r
  ON e.channel = r.channel AND e.noise = r.noise GROUP BY e.channel) x""")

add("prepared_windows", lambda d: f"""
WITH {segments(d)}, w AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY start, stop, turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY start, stop, turn) - 1 AS i FROM seg)
SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous, bool_and(before IS NULL OR before < turn) AS ordered,
       bool_and(start >= 0 AND stop > start AND stop - start <= 30) AS in_bounds, {d.count_if('turn <> i')} AS moved FROM w GROUP BY conv_id""")

add("conversation_audit", lambda d: f"""
WITH {segments(d)}, x AS (SELECT *, lag(start) OVER w AS ps, lag(stop) OVER w AS pe FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn))
SELECT conv_id % 10 AS bucket, count(DISTINCT conv_id) AS sessions, {d.count_if('start < pe')} AS reused, {d.count_if('start = ps AND stop = pe')} AS repeated,
       CAST(sum(CASE WHEN speakers >= 2 AND first_ THEN 1 ELSE 0 END) AS bigint) AS two_speakers FROM (
  SELECT x.*, s.speakers, ps IS NULL AS first_ FROM x JOIN (SELECT conv_id, count(DISTINCT speaker) AS speakers FROM seg GROUP BY conv_id) s ON x.conv_id = s.conv_id) y GROUP BY conv_id % 10""")

add("yield_estimate", lambda d: f"""
WITH {segments(d)}, n AS (SELECT conv_id, turn, speaker, start, stop, lead(speaker) OVER w AS other, lead(start) OVER w AS os, lead(stop) OVER w AS oe FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn)),
l AS (SELECT conv_id % 4 AS channel, CASE WHEN other IS NULL THEN 'skip:last' WHEN other = speaker THEN 'skip:same_speaker' WHEN os - stop > 2.5e0 THEN 'skip:gap'
        WHEN os >= stop THEN 'none' WHEN oe - os <= 1.2e0 AND oe <= stop + 0.2e0 THEN 'backchannel' ELSE 'interrupt' END AS label, greatest(stop, oe) - least(start, os) AS seconds FROM n)
SELECT channel, label, count(*) AS pairs, round(sum(CASE WHEN label LIKE 'skip%' THEN 0e0 ELSE seconds END), 4) AS seconds FROM l GROUP BY channel, label""")

add("similarity_distribution", lambda d: f"""
WITH t AS (SELECT conv_id, turn, {d.words("lower(text)")} AS w FROM conversations), p AS (
  SELECT a.conv_id % 4 AS channel, {"size(array_intersect(a.w, b.w)) / cast(size(array_union(a.w, b.w)) AS double)" if d.name == "spark" else "len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE"} AS s
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT channel, count(*) AS n, round(avg(s), 6) AS mean, round({d.median('s')}, 6) AS median, round({d.pct('s', 0.1)}, 6) AS p10, round({d.pct('s', 0.25)}, 6) AS p25,
       round(avg(CASE WHEN s < 0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS low_share FROM p GROUP BY channel""")

add("supplement_plan", lambda d: f"""
WITH y AS (SELECT channel, sum(CASE WHEN pair_id % 4 = 0 THEN hours ELSE 0e0 END) / sum(hours) AS yield FROM ({PAIRS}) p GROUP BY channel),
s AS (SELECT channel, sum(hours) AS selected FROM ({PAIRS}) p WHERE session_id % 3 = 0 GROUP BY channel)
SELECT y.channel, round(yield, 6) AS yield, round(coalesce(selected, 0e0) * yield, 4) AS expected, round(sum(coalesce(selected, 0e0) * yield) OVER (), 4) AS total,
       sum(coalesce(selected, 0e0) * yield) OVER () >= 100 AS feasible FROM y LEFT JOIN s ON y.channel = s.channel""")

add("evidence_status", lambda d: """
WITH r AS (SELECT source AS report, CASE WHEN count(*) < 5 THEN 'missing' WHEN avg(n_chars) > 600 THEN 'official' ELSE 'provisional' END AS status, bool_and(n_chars > 0) AS valid FROM documents GROUP BY source)
SELECT status, count(*) AS reports, bool_and(valid) AS all_valid, max(report) AS last_report FROM r GROUP BY status""")

add("rank_gate", lambda d: """
WITH rank_ AS (SELECT 'none' AS status, 0 AS rank_ UNION ALL SELECT 'provisional', 1 UNION ALL SELECT 'official', 2),
e AS (SELECT lang AS candidate, source AS criterion, CASE WHEN count(*) < 2 THEN 'none' WHEN avg(n_chars) > 600 THEN 'official' ELSE 'provisional' END AS status FROM documents GROUP BY lang, source)
SELECT candidate, count(*) AS criteria, min(rank_) AS least_rank, bool_and(rank_ >= 1) AS passed FROM e JOIN rank_ ON e.status = rank_.status GROUP BY candidate""")

add("extreme_rows", lambda d: f"""
SELECT source, round(avg(n_chars), 4) AS mean, {d.arg_max('doc_id', 'n_chars * 1000000 - doc_id')} AS longest, {d.arg_min('doc_id', 'n_chars * 1000000 + doc_id')} AS shortest, max(n_chars) AS top FROM documents GROUP BY source""")

# ---- panels and arms -----------------------------------------------------------------------------

#: Scores 0-4 of documents by arms, in two calls.
SCORES = """SELECT d.doc_id AS row_id, d.lang AS stratum, arm, concat('m', cast(arm % 2 AS string)) AS model, (d.n_chars + arm * 7 + d.doc_id) % 5 AS score,
  CASE WHEN d.doc_id % 9 = 0 THEN (d.n_chars + arm * 7) % 5 ELSE (d.n_chars + arm * 7 + d.doc_id) % 5 END AS again, d.doc_id % 3 AS call_group
  FROM documents d CROSS JOIN (SELECT r_regionkey AS arm FROM region WHERE r_regionkey < 4) a"""

add("arm_means", lambda d: f"""
SELECT arm, count(*) AS rows_, round(avg(s), 6) AS mean, round(avg(CASE WHEN s < 1 THEN 1e0 ELSE 0e0 END), 6) AS failure_rate FROM (
  SELECT arm, row_id, avg(cast(score AS double)) AS s FROM ({SCORES}) x GROUP BY arm, row_id) y GROUP BY arm""")

add("repeat_agreement", lambda d: f"""
SELECT s.score, count(x.row_id) AS n, {d.count_if('x.score = x.again')} AS same FROM (SELECT r_regionkey AS score FROM region) s LEFT JOIN ({SCORES}) x ON s.score = x.score GROUP BY s.score""")

add("paired_win_rate", lambda d: f"""
WITH m AS (SELECT arm, row_id, {d.median('cast(score AS double)')} AS s FROM ({SCORES}) x GROUP BY arm, row_id)
SELECT b.arm, count(*) AS n, round(avg(CASE WHEN b.s > a.s THEN 1e0 WHEN b.s = a.s THEN 0.5e0 ELSE 0e0 END), 6) AS win_rate, round(avg(CASE WHEN b.s >= 2 THEN 1e0 ELSE 0e0 END), 6) AS acceptable
FROM m a JOIN m b ON a.row_id = b.row_id WHERE a.arm = 0 AND b.arm > 0 GROUP BY b.arm""")

add("variant_gains", lambda d: f"""
WITH m AS (SELECT model, arm, avg(cast(score AS double)) AS mean FROM ({SCORES}) x GROUP BY model, arm),
best AS (SELECT model, arm, row_number() OVER (PARTITION BY model ORDER BY mean DESC, arm) AS r FROM m)
SELECT v.model, v.arm, round(avg(cast(v.score - b.score AS double)), 6) AS gain, avg(cast(v.score - b.score AS double)) >= -0.3e0 AS not_inferior
FROM ({SCORES}) v JOIN best ON best.model = v.model AND best.r = 1 JOIN ({SCORES}) b ON b.model = best.model AND b.arm = best.arm AND b.row_id = v.row_id GROUP BY v.model, v.arm""")

add("best_arms", lambda d: f"""
WITH s AS (SELECT model, arm, stratum, call_group, cast(score AS double) AS score FROM ({SCORES}) x),
g AS (SELECT model, arm, stratum, call_group, avg(score) AS mean, count(*) AS n FROM s GROUP BY GROUPING SETS ((model, arm), (model, arm, stratum), (model, arm, call_group)))
SELECT model, arm, coalesce(stratum, 'all') AS stratum, coalesce(call_group, -1) AS call_group, round(mean, 6) AS mean, n,
       row_number() OVER (PARTITION BY model, stratum, call_group ORDER BY mean DESC, arm) = 1 AS best FROM g""")

add("two_judges", lambda d: f"""
WITH m AS (SELECT arm, avg(cast(score AS double)) AS first, avg(cast(again AS double)) AS second, avg(cast(score AS double)) - 1.96e0 * stddev_samp(cast(score AS double)) / sqrt(count(*)) AS low,
  min(stratum) AS s FROM ({SCORES}) x GROUP BY arm), base AS (SELECT first, second, low FROM m WHERE arm = 0)
SELECT m.arm, round(m.first - base.first, 6) AS gain_first, round(m.second - base.second, 6) AS gain_second, m.first > base.first AND m.second > base.second AND m.low > 0 AS eligible,
       row_number() OVER (ORDER BY CASE WHEN m.first > base.first AND m.second > base.second THEN 0 ELSE 1 END, m.first + m.second DESC, m.arm) = 1 AS chosen FROM m CROSS JOIN base""")

add("engineering_gate", lambda d: f"""
WITH m AS (SELECT arm, stratum, avg(cast(score AS double)) AS mean FROM ({SCORES}) x GROUP BY arm, stratum)
SELECT v.arm, round(avg(v.mean), 6) AS mean, round(avg(v.mean - b.mean), 6) AS gain, avg(v.mean) >= 1.5e0 AS mean_ok, avg(v.mean - b.mean) >= -0.1e0 AS gain_ok,
       bool_and(v.mean - b.mean >= -0.5e0) AS no_subgroup_loss, avg(v.mean) >= 1.5e0 AND avg(v.mean - b.mean) >= -0.1e0 AND bool_and(v.mean - b.mean >= -0.5e0) AS replace_
FROM m v JOIN m b ON v.stratum = b.stratum AND b.arm = 0 WHERE v.arm > 0 GROUP BY v.arm""")

add("arm_ranking", lambda d: f"""
SELECT arm, round(mean, 6) AS mean, round(failures, 6) AS failures, CAST(row_number() OVER (ORDER BY failures, mean DESC, arm) AS bigint) AS place,
       mean >= 1.5e0 AND failures <= 0.3e0 AS promoted FROM (SELECT arm, avg(cast(score AS double)) AS mean, avg(CASE WHEN score = 0 THEN 1e0 ELSE 0e0 END) AS failures FROM ({SCORES}) x GROUP BY arm) y""")

add("lowest_p90_tied", lambda d: f"""
WITH p AS (SELECT arm, {d.pct('cast(score * 10 + row_id % 7 AS double)', 0.9)} AS p90 FROM ({SCORES}) x GROUP BY arm)
SELECT max(arm) AS chosen, round(min(p90), 6) AS lowest FROM p WHERE p90 <= (SELECT min(p90) FROM p) + 5""")

add("eligible_then_tied", lambda d: f"""
WITH c AS (SELECT arm, avg(cast(score AS double)) AS gain, avg(CASE WHEN score = 0 THEN 1e0 ELSE 0e0 END) AS wrong FROM ({SCORES}) x GROUP BY arm),
e AS (SELECT * FROM c WHERE wrong <= 0.5e0), t AS (SELECT * FROM e WHERE gain >= (SELECT max(gain) FROM e) - 0.05e0)
SELECT arm, round(gain, 6) AS gain, round(wrong, 6) AS wrong FROM (SELECT *, row_number() OVER (ORDER BY wrong, gain DESC, arm) AS r FROM t) x WHERE r = 1""")

add("agreement_rates", lambda d: """
SELECT stratum, n, agreed, round(agreed / cast(n AS double), 6) AS agreement, confirmed,
       round(greatest(0e0, (p + z / (2 * m) - h) / (1 + z / m)), 4) AS low, round(least(1e0, (p + z / (2 * m) + h) / (1 + z / m)), 4) AS high FROM (
  SELECT *, 1.959963984540054e0 * sqrt((p * (1 - p) + z / (4 * m)) / m) AS h FROM (
    SELECT d.lang AS stratum, count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS bigint) AS agreed, CAST(sum(CASE WHEN a = b AND a = 1 THEN 1 ELSE 0 END) AS bigint) AS confirmed,
           sum(CASE WHEN a = b AND a = 1 THEN 1e0 ELSE 0e0 END) / greatest(1, sum(CASE WHEN a = b THEN 1 ELSE 0 END)) AS p, greatest(1, sum(CASE WHEN a = b THEN 1 ELSE 0 END)) AS m,
           1.959963984540054e0 * 1.959963984540054e0 AS z
    FROM documents d JOIN (SELECT doc_id, max(quality) AS a, max(CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END) AS b FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id GROUP BY d.lang) x) y""")

add("trial_grains", lambda d: """
SELECT coalesce(candidate, 'all') AS candidate, coalesce(hold, 'all') AS hold, count(*) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN value >= 50 THEN 1e0 ELSE 0e0 END), 6) AS rate FROM (
  SELECT split_part(name, '|', 1) AS candidate, split_part(name, '|', 2) AS hold, value FROM (
    SELECT concat(event_type, '|', cast(user_id % 3 AS string)) AS name, value FROM events) e) x GROUP BY GROUPING SETS ((candidate, hold), (candidate), ())""")

add("grid_fit", lambda d: """
WITH p AS (SELECT 'q4' AS precision_, 3 AS preference, 2.1e0 AS fixed, 0.00004e0 AS per_token UNION ALL SELECT 'q8', 2, 4.4e0, 0.00008e0 UNION ALL SELECT 'f16', 1, 8.2e0, 0.00016e0),
g AS (SELECT r_regionkey + 1 AS sessions, 1000 * (r_regionkey + 1) AS context FROM region), b AS (SELECT n_nationkey AS profile, 2e0 + n_nationkey AS budget FROM nation WHERE n_nationkey < 12)
SELECT profile, sessions, precision_, round(need, 4) AS need FROM (
  SELECT b.profile, g.sessions, p.precision_, p.fixed + g.sessions * (0.1e0 + p.per_token * g.context) AS need,
         row_number() OVER (PARTITION BY b.profile, g.sessions ORDER BY p.preference) AS r
  FROM p CROSS JOIN g CROSS JOIN b WHERE p.fixed + g.sessions * (0.1e0 + p.per_token * g.context) <= b.budget) x WHERE r = 1""")

add("latest_or_median", lambda d: f"""
SELECT k, runs, round(CASE WHEN runs >= 3 AND greatest(a, b) > 2 * least(a, b) THEN m ELSE a END, 6) AS value FROM (
  SELECT k, count(*) AS runs, max(CASE WHEN r = 1 THEN value END) AS a, coalesce(max(CASE WHEN r = 2 THEN value END), max(CASE WHEN r = 1 THEN value END)) AS b,
         {d.median('CASE WHEN r <= 3 THEN value END')} AS m FROM (
    SELECT user_id AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x GROUP BY k) y""")

add("real_time_factors", lambda d: f"""
SELECT event_type, round({d.median('f')}, 6) AS p50, round({d.pct('f', 0.95)}, 6) AS p95, round(max(f), 6) AS worst,
       CASE WHEN {d.pct('f', 0.95)} < 1 THEN 'promote' WHEN {d.median('f')} < 1 THEN 'review' ELSE 'reject' END AS rule
FROM (SELECT event_type, value / (10e0 + user_id % 50) AS f FROM events) x GROUP BY event_type""")

add("timing_rates", lambda d: """
SELECT event_type AS kind, user_id % 4 AS timing, count(*) AS n, round(avg(CASE WHEN value >= 50 THEN 1e0 ELSE 0e0 END), 6) AS rate, round(max(value), 6) AS worst FROM events GROUP BY event_type, user_id % 4""")

add("threshold_choice", lambda d: """
WITH t AS (SELECT r_regionkey * 400 + 100 AS threshold FROM region),
b AS (SELECT threshold, 0.5e0 * (sum(CASE WHEN quality = 1 AND n_chars >= threshold THEN 1 ELSE 0 END) / cast(greatest(1, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)) AS double)
  + sum(CASE WHEN quality = 0 AND n_chars < threshold THEN 1 ELSE 0 END) / cast(greatest(1, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)) AS double)) AS balanced
  FROM documents JOIN labels USING (doc_id) CROSS JOIN t GROUP BY threshold)
SELECT threshold, round(balanced, 6) AS balanced, row_number() OVER (ORDER BY round(balanced, 12) DESC, threshold) = 1 AS chosen FROM b""")

add("memory_peaks", lambda d: f"""
WITH s AS (SELECT {d.hour('ts')} AS stamp, CASE WHEN event_type IN ('click', 'view') THEN 'llm' ELSE 'asr' END AS role, sum(value) AS mib FROM events GROUP BY {d.hour('ts')}, CASE WHEN event_type IN ('click', 'view') THEN 'llm' ELSE 'asr' END),
t AS (SELECT stamp, sum(mib) AS total FROM s GROUP BY stamp HAVING count(*) = 2)
SELECT (SELECT count(*) FROM (SELECT DISTINCT stamp FROM s) x) AS samples, round((SELECT max(mib) FROM s WHERE role = 'llm'), 4) AS llm, round((SELECT max(mib) FROM s WHERE role = 'asr'), 4) AS asr, round(max(total), 4) AS stack FROM t""")



def medians(d, source: str, group: str, value: str) -> str:
    """Common table expressions that end in m(group, median) of few groups of many rows.

    `percentile` keeps all values of a group in a task. For Spark, values are counted in ranges between approximate quantiles,
    the ranges' counts tell which hold the middle, and only there values are ranked.
    """
    if d.name != "spark":
        return f"m AS (SELECT {group}, {d.median(value)} AS median FROM {source} GROUP BY {group})"
    cuts = f"percentile_approx({value}, array({', '.join(f'{i / 50}e0' for i in range(1, 50))}), 10000)"
    return f"""q AS (SELECT {group}, {cuts} AS cuts FROM {source} WHERE {value} IS NOT NULL GROUP BY {group}),
d AS (SELECT {group}, {value} AS v, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY {group}, {value}),
c AS (SELECT /*+ BROADCAST(q) */ d.{group}, size(filter(q.cuts, k -> k < d.v)) AS bin, d.v, d.n FROM d JOIN q ON d.{group} = q.{group}),
t AS (SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY {group}) - 1 AS last FROM (SELECT {group}, bin, sum(n) AS n FROM c GROUP BY {group}, bin) b),
h AS (SELECT {group}, bin, before, last FROM t WHERE before <= last DIV 2 + last % 2 AND before + n > last DIV 2),
r AS (SELECT /*+ BROADCAST(h) */ c.{group}, c.v, h.last, c.n, h.before + sum(c.n) OVER (PARTITION BY c.{group}, c.bin ORDER BY c.v) AS upto FROM c JOIN h ON c.{group} = h.{group} AND c.bin = h.bin),
m AS (SELECT {group}, CASE WHEN min(v) = max(v) THEN min(v) ELSE 0.5e0 * min(v) + 0.5e0 * max(v) END AS median FROM r WHERE upto > last DIV 2 AND upto - n <= last DIV 2 + last % 2 GROUP BY {group})"""


add("failure_stages", lambda d: f"""
WITH x AS (SELECT event_id, 'wait' AS stage, value AS ms FROM events UNION ALL SELECT event_id, 'user', user_id * 0.7e0 FROM events UNION ALL SELECT event_id, 'kind', length(event_type) * 9e0 FROM events),
{medians(d, 'x', 'stage', 'ms')},
e AS (SELECT {'/*+ BROADCAST(m) */ ' if d.name == 'spark' else ''}x.event_id, x.stage, x.ms - m.median AS excess, row_number() OVER (PARTITION BY x.event_id ORDER BY x.ms - m.median DESC, x.stage) AS r FROM x JOIN m ON x.stage = m.stage)
SELECT stage, count(*) AS n, round(avg(excess), 6) AS mean_excess FROM e WHERE r = 1 AND excess > 0 GROUP BY stage""")

add("study_summary", lambda d: f"""
WITH t AS (SELECT u.user_id, u.user_id % 7 <> 0 AS consent, e.value, e.event_type = 'click' AS ack FROM events e JOIN (SELECT DISTINCT user_id FROM events) u ON e.user_id = u.user_id),
c AS (SELECT user_id, avg(value) AS rating, {d.count_if('ack')} AS acks, count(*) AS turns FROM t WHERE consent GROUP BY user_id)
SELECT count(*) AS participants, round(avg(rating), 6) AS mean, round(1.96e0 * stddev_samp(rating) / sqrt(count(*)), 6) AS half_width, CAST(sum(acks) AS bigint) AS acks, CAST(sum(turns) AS bigint) AS turns,
       count(*) >= 20 AS enough, sum(acks) > 0 AS acknowledged, count(*) >= 20 AND sum(acks) > 0 AS passed FROM c""")

# ---- samples and orders --------------------------------------------------------------------------

add("low_similarity_first", lambda d: "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations WHERE length(text) % 7 = 0) x WHERE r <= 20")
add("stratum_sample", lambda d: f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {d.sha('''concat('11:', cast(doc_id AS string))''')}, doc_id) AS r FROM documents) x WHERE r <= 12")
add("session_top_restored", lambda d: f"""
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS bigint) AS place FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {d.sha('cast(doc_id AS string)')}, doc_id) AS r FROM documents) x WHERE r <= 8""")
add("fresh_panel", lambda d: f"""
WITH s AS (SELECT source, {d.sha('source')} AS h FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY h) AS r FROM s)
SELECT source, doc_id FROM (SELECT x.source, x.doc_id, row_number() OVER (PARTITION BY x.source ORDER BY {d.sha('cast(x.doc_id AS string)')}, x.doc_id) AS k
  FROM documents x JOIN r ON x.source = r.source WHERE r.r > 5 AND r.r <= 12) y WHERE k <= 4""")


def _folds(d, ranked: str) -> str:
    return f"""WITH n AS (SELECT min(n) AS least FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality) x)
SELECT l.doc_id, l.quality, {d.hexint('substr(md5(d.source), 1, 7)')} % 5 AS fold FROM {ranked} l CROSS JOIN n JOIN documents d ON d.doc_id = l.doc_id WHERE l.place <= n.least"""


KINDS = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'positive' WHEN quality = 0 THEN 'backchannel' ELSE 'clean' END AS kind FROM labels"


def _filled(ranked: str) -> str:
    return f"""WITH p AS (SELECT count(*) * 4 AS n FROM ({KINDS}) k WHERE kind = 'positive')
SELECT r.doc_id, r.kind FROM {ranked} r CROSS JOIN p WHERE r.kind = 'positive' OR r.place <= p.n"""


DUCK = Duck()


@query(_folds(DUCK, "(SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256(doc_id::VARCHAR), doc_id) AS place FROM labels)"))
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within a class come from sums over ranges, as a class may hold most rows."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return opened(spark, sf_dir, _folds(Spark(), "{ranked}"), ranked=placed(rows, "quality", ["h", "doc_id"]))


@query(_filled(f"(SELECT doc_id, kind, row_number() OVER (PARTITION BY kind = 'positive' ORDER BY CASE kind WHEN 'clean' THEN 1 ELSE 0 END, sha256(doc_id::VARCHAR), doc_id) AS place FROM ({KINDS}) k)"))
def filled_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opened(spark, sf_dir, KINDS).select("*", (F.col("kind") == "positive").alias("of"), (F.col("kind") == "clean").alias("last"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return opened(spark, sf_dir, _filled("{ranked}"), ranked=placed(rows, "of", ["last", "h", "doc_id"]))


add("arm_order", lambda d: f"""
SELECT row_id, arm, CAST(row_number() OVER (PARTITION BY row_id ORDER BY {d.sha('''concat_ws('|', 'stage', '7', cast(row_id AS string), cast(arm AS string))''')}) AS bigint) AS place FROM ({SCORES}) x""")
add("recent_history", lambda d: """
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) x WHERE r <= 4""")
add("heard_prefix", lambda d: """
SELECT conv_id, turn, least(n, greatest(0, heard - before)) AS heard_chars, heard >= before + n AS whole FROM (
  SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 100 + conv_id % 200 AS heard FROM conversations) x
WHERE heard > before""".replace("least(n, greatest(0, heard - before))", "CAST(least(n, greatest(0, heard - before)) AS bigint)"))

RUNS = """f AS (SELECT user_id, event_id, value, value < 30 AS silent FROM events),
g AS (SELECT *, CASE WHEN silent = lag(silent) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM f),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM g)"""
add("internal_pauses", lambda d: f"""
WITH {RUNS} SELECT user_id, min(event_id) AS first_event, count(*) AS frames FROM h WHERE silent GROUP BY user_id, run HAVING count(*) >= 2 AND min(i) > 3 AND max(i) <= min(n) - 3""")
add("shortened_runs", lambda d: f"""
WITH {RUNS} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM h) x WHERE NOT silent OR k <= 2""")
add("rolling_spread", lambda d: """
SELECT event_id, round(stddev_pop(value) OVER w, 5) AS spread FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
add("stage_stamps", lambda d: f"""
SELECT user_id, event_id, round(1000 * (s - min(s) OVER (PARTITION BY user_id)), 3) AS ms FROM (SELECT user_id, event_id, {d.seconds('ts')} AS s FROM events) x""")
add("client_acks", lambda d: """
SELECT user_id, event_id AS turn, ack FROM (SELECT user_id, event_id, value AS ack, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS r FROM events) x WHERE r = 1""")
