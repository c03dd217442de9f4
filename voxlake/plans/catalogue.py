"""The manifest, interval, selection, audit, statistics and event queries."""

from __future__ import annotations

from voxlake.functions.dialect import digest_mod

from .sql import add

# ---- stand-ins for the tables of a speech corpus -------------------------------------------------

PAIRS = "SELECT o_orderkey AS pair_id, o_orderpriority AS channel, o_custkey AS session_id, o_totalprice / 3600 AS hours, o_orderstatus AS status FROM orders"

UTTERANCES = (
    "SELECT doc_id AS utt_id, source AS session_id, lang AS channel, n_chars / 150e0 AS duration, text, length(text) AS len FROM documents"
)


def segments(_d) -> str:
    return """seg AS (
  SELECT conv_id, turn, speaker, round(greatest(0e0, s - dur), 6) AS start, round(greatest(0e0, s - dur) + dur, 6) AS stop FROM (
    SELECT *, sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'user' ELSE 'assistant' END AS speaker,
             length(text) / CASE WHEN turn % 4 = 3 THEN 300e0 ELSE 15e0 END AS dur,
             CASE WHEN turn > 0 THEN ((conv_id * 7 + turn * 3) % 5 - 2) * 8e-1 ELSE 0e0 END AS gap FROM conversations) a) b)"""


#: Seconds of a bin of time. Intervals are joined by session and bin, so a long session is many small joins.
BIN = 30


def _bin(x: str) -> str:
    return f"CAST(floor(({x}) / {BIN}) AS bigint)"


def binned(d, rows: str, low: str = "start", high: str = "stop") -> str:
    """`rows` once for each bin that low..high touches; the oracle compares all rows of a session."""
    return rows if d.name == "duck" else f"(SELECT *, explode(sequence({_bin(low)}, {_bin(high)})) AS bin FROM {rows})"


def one_bin(d, a: str, b: str, low_a: str = "start", low_b: str = "start") -> str:
    """Condition that keeps a pair of binned rows in the bin in which their overlap begins."""
    return "" if d.name == "duck" else f" AND {a}.bin = {b}.bin AND {a}.bin = {_bin(f'greatest({a}.{low_a}, {b}.{low_b})')}"


def split_of(d, digest: str, chunks: int, test: int, val: int) -> str:
    m = digest_mod(d, digest, chunks)
    return f"CASE WHEN {m} < {test} THEN 'test' WHEN {m} < {val} THEN 'val' ELSE 'train' END"


def utt_split(d) -> str:
    return f"SELECT utt_id, session_id, channel, duration, text, {split_of(d, 'md5(cast(utt_id AS string))', 4, 5, 8)} AS split FROM ({UTTERANCES}) u"


# ---- aggregates and dominance --------------------------------------------------------------------

add("balance_audit", lambda d: f"""
WITH p AS ({PAIRS}), c AS (
  SELECT channel, count(*) AS pairs, count(DISTINCT session_id) AS sessions, sum(hours) AS hours FROM p GROUP BY channel)
SELECT channel, pairs, sessions, round(hours, 4) AS hours, round(hours / sum(hours) OVER (), 6) AS share,
       row_number() OVER (ORDER BY hours DESC, channel) = 1 AS dominant FROM c""")

add("dominance", lambda d: f"""
WITH c AS (SELECT channel, sum(hours) AS hours FROM ({PAIRS}) p GROUP BY channel),
r AS (SELECT channel, hours, sum(hours) OVER () AS total, row_number() OVER (ORDER BY hours DESC, channel) AS r FROM c)
SELECT channel, round(hours / total, 6) AS share, round(greatest(0e0, hours - 0.15e0 * total), 4) AS hours_to_replace,
       round(greatest(0e0, hours / 0.15e0 - total), 4) AS hours_to_add FROM r WHERE r = 1""")

add("scope_summary", lambda d: f"""
SELECT channel, count(DISTINCT session_id) AS episodes, round(sum(hours), 4) AS hours, {d.joined('status')} AS statuses
FROM ({PAIRS}) p GROUP BY channel""")

add("selection_audit", lambda d: f"""
WITH c AS (SELECT channel, sum(hours) AS hours, count(*) AS n FROM ({PAIRS}) p GROUP BY channel)
SELECT round(sum(hours), 4) AS hours, CAST(sum(n) AS bigint) AS pairs, round(max(hours) / sum(hours), 6) AS largest_share,
       max(hours) <= 0.55e0 * sum(hours) AS share_ok, bool_and(n > 0) AS all_present FROM c""")

add("event_counts_grouping_sets", lambda d: """
SELECT coalesce(event_type, 'all') AS event_type, coalesce(bucket, -1) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users
FROM (SELECT event_type, user_id % 10 AS bucket, user_id FROM events) e GROUP BY GROUPING SETS ((event_type, bucket), (event_type), ())""")

add("requirement_vector", lambda d: """
SELECT requirement, coalesce(passed, false) AS passed FROM (
  SELECT 'rows' AS requirement, count(*) > 0 AS passed FROM documents
  UNION ALL SELECT 'labels', count(*) > 100 FROM labels
  UNION ALL SELECT 'toxic_share', avg(CAST(toxic AS double)) < 0.05e0 FROM labels
  UNION ALL SELECT 'none', bool_and(quality = 1) FROM labels WHERE doc_id < 0) r""")

add("coverage_ratio", lambda d: """
SELECT d.source, count(*) AS expected, count(l.doc_id) AS found, round(count(l.doc_id) / cast(count(*) AS double), 6) AS ratio
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY d.source""")

add("review_completeness", lambda d: """
SELECT status, count(*) AS n, count(DISTINCT doc_id) AS ids FROM (
  SELECT doc_id, CASE WHEN quality IS NULL THEN 'blank' WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS status
  FROM labels) s GROUP BY status""")

add("checkpoint_choice", lambda d: """
SELECT l_linestatus, k.step, round(k.loss, 6) AS loss, scopes = 1 AS single_scope FROM (
  SELECT l_linestatus, min(struct_loss) AS loss, min(step) AS step, count(DISTINCT scope) AS scopes FROM (
    SELECT l_linestatus, l_discount + l_tax AS struct_loss, l_orderkey AS step, l_linestatus AS scope,
           rank() OVER (PARTITION BY l_linestatus ORDER BY l_discount + l_tax, l_orderkey) AS r FROM lineitem) x WHERE r = 1 GROUP BY l_linestatus) k""")

# ---- text and quality ----------------------------------------------------------------------------

REASON = """CASE WHEN duration IS NULL THEN 'invalid_duration' WHEN duration < 1 THEN 'too_short' WHEN duration > 20 THEN 'too_long'
     WHEN letters = 0 OR latin < 0.35e0 * letters THEN 'script' WHEN words < 3 THEN 'few_words' ELSE 'ok' END"""


def quality(d) -> str:
    letters, latin = d.replace("text", r"[^\p{L}]", ""), d.replace("text", "[^A-Za-z]", "")
    return f"""SELECT utt_id, channel, duration, {REASON} AS reason FROM (
  SELECT utt_id, channel, duration, length({letters}) AS letters, length({latin}) AS latin, {d.size(d.words('text'))} AS words FROM ({UTTERANCES}) u) q"""


add("quality_reasons", lambda d: f"SELECT utt_id, round(duration, 6) AS duration, reason FROM ({quality(d)}) r")
add("quality_skip_counts", lambda d: f"""
SELECT channel, reason, count(*) AS n, round(sum(duration) / 3600, 6) AS hours FROM ({quality(d)}) r GROUP BY channel, reason""")

add("tokenize_counts", lambda d: f"""
SELECT utt_id, {d.size(d.words('text'))} AS tokens, length({d.replace('text', '[ \\t\\n\\r]+', '')}) AS characters FROM ({UTTERANCES}) u""")

add("caption_clean", lambda d: f"""
SELECT page_id, CASE WHEN {d.size(d.words('t'))} >= 2 THEN trim(t) END AS caption FROM (
  SELECT page_id, {d.replace('html', r'\[[^\]]*\]|&nbsp;|<[^>]*>', ' ')} AS t FROM pages) c""")

add("script_ratio", lambda d: f"""
SELECT doc_id, round(CASE WHEN n = 0 THEN 0e0 ELSE a / cast(n AS double) END, 6) AS ratio FROM (
  SELECT doc_id, length({d.replace('text', r'[^\p{L}]', '')}) AS n, length({d.replace('text', '[^A-Za-z]', '')}) AS a FROM documents) x""")

add("repetition_ratio", lambda d: f"""
SELECT utt_id, round(max(n) / cast(sum(n) AS double), 6) AS repetition FROM (
  SELECT utt_id, w, count(*) AS n FROM (SELECT utt_id, {d.explode(d.words('text'), 'w')} FROM ({UTTERANCES}) u) x GROUP BY utt_id, w) y
GROUP BY utt_id""")

add("props_json", lambda d: f"""
SELECT event_type, count(*) AS n, CAST(sum(cast({d.json('props', 'k')} AS bigint)) AS bigint) AS k FROM events GROUP BY event_type""")

# ---- hashing, splits, samples --------------------------------------------------------------------

add("split_md5", lambda d: f"SELECT utt_id, split FROM ({utt_split(d)}) s")
add("split_sha_full", lambda d: f"SELECT doc_id, {split_of(d, d.sha('cast(doc_id AS string)'), 8, 15, 30)} AS split FROM documents")
SEEDED = "concat('42:', cast(doc_id AS string))"
add("split_sha_seeded", lambda d: f"SELECT doc_id, {digest_mod(d, d.sha(SEEDED), 2)} AS bucket FROM documents")
add("split_leak_audit", lambda d: f"""
SELECT session_id, count(DISTINCT split) AS splits, count(DISTINCT split) > 1 AS leak FROM ({utt_split(d)}) s GROUP BY session_id""")
add("text_cross_split", lambda d: f"""
SELECT {d.sha('text')} AS digest, count(*) AS n, count(DISTINCT split) AS splits FROM ({utt_split(d)}) s
GROUP BY {d.sha('text')} HAVING count(DISTINCT split) > 1""")
add("hash_topk_per_group", lambda d: f"""
SELECT lang, source, doc_id, r FROM (
  SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {d.sha('cast(doc_id AS string)')}, doc_id) AS r
  FROM documents) x WHERE r <= 3""")
add("stratified_round_robin", lambda d: f"""
SELECT channel, session_id, pair_id, place FROM (
  SELECT channel, session_id, pair_id, row_number() OVER (PARTITION BY channel ORDER BY r, session_id, pair_id) AS place FROM (
    SELECT channel, session_id, pair_id, row_number() OVER (PARTITION BY channel, session_id ORDER BY {d.sha('cast(pair_id AS string)')}, pair_id) AS r
    FROM ({PAIRS}) p) x) y WHERE place <= 50""")
# ---- joins ---------------------------------------------------------------------------------------

add("qa_apply", lambda d: """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_sampled' WHEN l.n > 1 THEN 'refused_repeated' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END AS review
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, count(*) AS n FROM (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 20 = 0) x GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
add("rights_apply", lambda d: """
SELECT c.c_custkey, n.n_name AS scope, coalesce(r.r_name, 'none') AS permission
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
add("unknown_ids", lambda d: """
SELECT count(*) AS unknown FROM labels l LEFT ANTI JOIN documents d ON l.doc_id = d.doc_id""" if d.name == "spark" else """
SELECT count(*) AS unknown FROM labels l ANTI JOIN documents d ON l.doc_id = d.doc_id""")
add("export_reconcile", lambda d: """
WITH x AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS keys, CAST(sum(CASE WHEN x.k IS NULL THEN 1 ELSE 0 END) AS bigint) AS missing, CAST(sum(CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 0 END) AS bigint) AS extra,
       CAST(sum(CASE WHEN abs(x.v - o.o_totalprice) > 1 THEN 1 ELSE 0 END) AS bigint) AS differing FROM orders o FULL OUTER JOIN x ON o.o_orderkey = x.k""")
add("missing_extra", lambda d: """
SELECT 'missing' AS kind, d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL
UNION ALL SELECT 'extra', l.doc_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL""")
add("exclude_used", lambda d: "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
add("covered_only", lambda d: "SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
add("meta_defaults", lambda d: """
SELECT c.conv_id, c.turn, coalesce(l.quality, -1) AS quality FROM conversations c LEFT JOIN
  (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON c.conv_id = l.doc_id""")
add("paired_arms", lambda d: """
WITH a AS (SELECT l_orderkey AS k, avg(l_discount) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey),
b AS (SELECT l_orderkey AS k, avg(l_discount) AS x FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey)
SELECT count(*) AS n, round(avg(a.x - b.x), 6) AS gain, round(stddev_samp(a.x - b.x), 6) AS sd FROM a JOIN b ON a.k = b.k""")

# ---- intervals -----------------------------------------------------------------------------------

add("turn_segments", lambda d: f"WITH {segments(d)} SELECT * FROM seg")
add("merge_same_speaker", lambda d: f"""
WITH {segments(d)}, a AS (
  SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND start - max(stop) OVER (PARTITION BY conv_id ORDER BY start, stop, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.5e0
              THEN 0 ELSE 1 END AS fresh FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn)),
b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY start, stop, turn ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM a)
SELECT conv_id, run, min(speaker) AS speaker, min(start) AS start, max(stop) AS stop, count(*) AS turns FROM b GROUP BY conv_id, run""")
ISLANDS = """a AS (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY conv_id ORDER BY start, stop, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM seg),
b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY start, stop, turn ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM a),
m AS (SELECT conv_id, run, min(start) AS start, max(stop) AS stop FROM b GROUP BY conv_id, run)"""
add("merge_intervals", lambda d: f"WITH {segments(d)}, {ISLANDS} SELECT * FROM m")
add("interval_gaps", lambda d: f"""
WITH {segments(d)}, {ISLANDS}, g AS (SELECT conv_id, coalesce(lag(stop) OVER (PARTITION BY conv_id ORDER BY run), 0e0) AS gap_start, start AS gap_stop FROM m)
SELECT * FROM g WHERE gap_start < gap_stop""")
add("speaker_overlaps", lambda d: f"""
WITH {segments(d)} SELECT a.conv_id, a.turn AS one, b.turn AS two, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop
FROM {binned(d, 'seg')} a JOIN {binned(d, 'seg')} b ON a.conv_id = b.conv_id{one_bin(d, 'a', 'b')} AND a.turn < b.turn AND a.speaker <> b.speaker AND a.start < b.stop AND b.start < a.stop""")
add("reused_spans", lambda d: f"""
WITH {segments(d)}, p AS (SELECT conv_id, start, lag(stop) OVER (PARTITION BY conv_id ORDER BY start, stop, turn) AS before FROM seg)
SELECT conv_id, CAST(sum(CASE WHEN start < before THEN 1 ELSE 0 END) AS bigint) AS reused FROM p GROUP BY conv_id""")
add("prior_speaker_asof", lambda d: f"""
WITH {segments(d)} SELECT a.conv_id, a.turn, max(b.stop) AS prior_stop FROM {binned(d, 'seg', 'start - 2.5e0', 'start')} a JOIN {binned(d, 'seg', 'stop', 'stop')} b
ON a.conv_id = b.conv_id{'' if d.name == 'duck' else ' AND a.bin = b.bin'} AND a.speaker <> b.speaker AND b.start < a.start AND b.stop <= a.start AND a.start - b.stop <= 2.5e0 GROUP BY a.conv_id, a.turn""")
ADJACENT = """adj AS (
  SELECT conv_id, turn, speaker, start, stop, lead(speaker) OVER w AS next_speaker, lead(start) OVER w AS next_start, lead(stop) OVER w AS next_stop
  FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn))"""
add("adjacent_pairs", lambda d: f"""
WITH {segments(d)}, {ADJACENT} SELECT conv_id, turn, start, next_stop, round(next_start - stop, 6) AS response_gap
FROM adj WHERE speaker = 'user' AND next_speaker = 'assistant'""")
add("interaction_labels", lambda d: f"""
WITH {segments(d)}, {ADJACENT} SELECT conv_id, turn, CASE WHEN next_start >= stop THEN 'none'
  WHEN next_stop - next_start <= 1.2e0 AND next_stop <= stop + 0.2e0 THEN 'backchannel' ELSE 'interrupt' END AS label
FROM adj WHERE next_speaker IS NOT NULL AND speaker <> next_speaker""")
add("backchannel_flanks", lambda d: f"""
WITH {segments(d)}, f AS (
  SELECT *, lag(speaker) OVER w AS ps, lag(stop) OVER w AS pe, lead(speaker) OVER w AS ns, lead(start) OVER w AS nb
  FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn))
SELECT conv_id, turn FROM f WHERE stop - start BETWEEN 0.15e0 AND 0.9e0 AND ps <> speaker AND ns <> speaker AND start - pe < 1 AND nb - stop < 1.5e0""")
add("turns_last_end", lambda d: f"""
WITH {segments(d)}, a AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY conv_id ORDER BY start, stop, turn) THEN 0 ELSE 1 END AS fresh FROM seg),
b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY start, stop, turn ROWS UNBOUNDED PRECEDING) AS bigint) AS run,
             row_number() OVER (PARTITION BY conv_id ORDER BY start, stop, turn) AS r FROM a)
SELECT conv_id, run, min(speaker) AS speaker, min(start) AS start, {d.arg_max('stop', 'r')} AS stop FROM b GROUP BY conv_id, run""")
add("speaker_evidence", lambda d: f"""
WITH {segments(d)}, s AS (SELECT conv_id, speaker, sum(stop - start) AS seconds FROM seg GROUP BY conv_id, speaker),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seconds DESC, speaker) AS r, sum(seconds) OVER (PARTITION BY conv_id) AS total FROM s)
SELECT conv_id, round(sum(CASE WHEN r = 2 THEN seconds ELSE 0e0 END), 4) AS second_seconds,
       round(sum(CASE WHEN r = 2 THEN seconds / total ELSE 0e0 END), 4) AS second_share FROM r GROUP BY conv_id""")
add("contiguity_audit", lambda d: """
SELECT conv_id, count(*) AS turns, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous
FROM conversations GROUP BY conv_id""")
add("episode_inventory", lambda d: f"""
WITH {segments(d)} SELECT conv_id, round(sum(greatest(stop - start, 0e0)), 4) AS caption_seconds, round(max(stop) - min(start), 4) AS timeline_seconds
FROM seg GROUP BY conv_id""")

# ---- statistics ----------------------------------------------------------------------------------

add("manifest_audit", lambda d: f"""
SELECT split, count(*) AS n, round(sum(duration) / 3600, 6) AS hours, count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT session_id) AS sessions
FROM ({utt_split(d)}) s GROUP BY split""")
add("latency_summary", lambda d: f"""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round({d.pct('value', 0.5)}, 6) AS p50, round({d.pct('value', 0.95)}, 6) AS p95,
       round(max(value), 6) AS worst, {d.pct('value', 0.95)} <= 100 AS gate FROM events GROUP BY event_type""")
add("latency_inf_late", lambda d: f"""
SELECT event_type, count(*) AS n, count(v) AS finite, round({d.pct("coalesce(v, 1e12)", 0.9)}, 6) AS p90 FROM (
  SELECT event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events) x GROUP BY event_type""")
CONFUSION = """c AS (
  SELECT CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS bigint) AS tp, CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS bigint) AS fp,
         CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS bigint) AS fn, CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS bigint) AS tn FROM (
    SELECT quality AS y, CASE WHEN n_chars BETWEEN 300 AND 3000 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)) x)"""
add("confusion_scores", lambda d: f"""
WITH {CONFUSION} SELECT tp, fp, fn, tn, round((tp + tn) / cast(greatest(1, tp + fp + fn + tn) AS double), 6) AS accuracy,
  round(tp / cast(greatest(1, tp + fp) AS double), 6) AS precision_, round(tp / cast(greatest(1, tp + fn) AS double), 6) AS recall,
  round(2 * tp / cast(greatest(1, 2 * tp + fp + fn) AS double), 6) AS f1, round(fp / cast(greatest(1, fp + tn) AS double), 6) AS far,
  round(fn / cast(greatest(1, fn + tp) AS double), 6) AS frr FROM c""")
add("threshold_sweep", lambda d: """
WITH t AS (SELECT n_regionkey * 500 + 250 AS threshold FROM nation GROUP BY n_regionkey)
SELECT threshold, round(0.5e0 * (sum(CASE WHEN quality = 1 AND n_chars >= threshold THEN 1 ELSE 0 END) / cast(greatest(1, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)) AS double)
  + sum(CASE WHEN quality = 0 AND n_chars < threshold THEN 1 ELSE 0 END) / cast(greatest(1, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)) AS double)), 6) AS balanced
FROM documents JOIN labels USING (doc_id) CROSS JOIN t GROUP BY threshold""")
add("wilson_ci", lambda d: """
SELECT source, n, k, round((p + z / (2 * n) - m) / (1 + z / n), 6) AS low, round((p + z / (2 * n) + m) / (1 + z / n), 6) AS high FROM (
  SELECT *, 1.96e0 * sqrt((p * (1 - p) + z / (4 * n)) / n) AS m FROM (
    SELECT source, count(*) AS n, CAST(sum(quality) AS bigint) AS k, avg(CAST(quality AS double)) AS p, 1.96e0 * 1.96e0 AS z
    FROM documents JOIN labels USING (doc_id) GROUP BY source) a) b""")
add("normal_ci", lambda d: """
SELECT event_type, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - 1.96e0 * sd / sqrt(n), 6) AS low, round(mean + 1.96e0 * sd / sqrt(n), 6) AS high
FROM (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY event_type) x""")
add("two_level_peak", lambda d: f"""
WITH s AS (SELECT {d.hour('ts')} AS stamp, event_type AS role, sum(value) AS v FROM events GROUP BY {d.hour('ts')}, event_type)
SELECT role, round(max(v), 4) AS peak, count(*) AS stamps FROM s GROUP BY role""")
add("stratified_rate", lambda d: """
WITH w AS (SELECT lang, count(*) / cast(sum(count(*)) OVER () AS double) AS weight FROM documents GROUP BY lang),
r AS (SELECT lang, avg(CAST(quality AS double)) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT round(sum(weight * rate), 6) AS rate, count(*) AS strata FROM w JOIN r ON w.lang = r.lang""")
add("score_histogram", lambda d: """
SELECT s.score, count(x.score) AS n FROM (SELECT r_regionkey AS score FROM region) s
LEFT JOIN (SELECT cast(doc_id % 4 AS int) AS score FROM documents) x ON s.score = x.score GROUP BY s.score""")
add("latest_per_key", lambda d: """
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1""")
add("stage_attribution", lambda d: f"""
WITH q AS (SELECT {d.pct('l_quantity', 0.5)} AS mq, {d.pct('l_discount', 0.5)} AS md FROM lineitem),
m AS (SELECT l_quantity - mq AS a, 100 * (l_discount - md) AS b FROM lineitem CROSS JOIN q)
SELECT CASE WHEN a >= b THEN 'quantity' ELSE 'discount' END AS stage, count(*) AS n FROM m WHERE greatest(a, b) > 0
GROUP BY CASE WHEN a >= b THEN 'quantity' ELSE 'discount' END""")

# ---- frames and event time -----------------------------------------------------------------------

add("rolling_context", lambda d: """
SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS peak, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
add("delta_features", lambda d: """
SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value), 6) AS delta FROM events""")
add("tumbling_counts", lambda d: f"""
SELECT {d.hour('ts')} AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY {d.hour('ts')}, event_type""")
