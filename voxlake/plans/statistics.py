"""Error rates, intervals, resampling and exact tests; ranks without one task for all rows."""

from __future__ import annotations

from .catalogue import segments
from .predicates import scored
from .sql import add

# ---- edit distance -------------------------------------------------------------------------------
# Tokens of a pair become one character each, so the built-in character distance is the token distance.
# The oracle's distance is of bytes: it walks the table of word distances row by row, and codes letters as single bytes.


def coded(words: str, among: str) -> str:
    """`words` as a string with a character per token: its place in `among`, from U+10000 on."""
    letter = f"decode(unhex(lpad(hex(65536 + array_position({among}, w)), 8, '0')), 'UTF-32')"
    return f"array_join(transform({words}, w -> {letter}), '')"


TABLE = """list_reduce(list_concat([range(0, len(h) + 1)], list_transform(range(1, len(r) + 1), lambda i: [i])), lambda prev, iv:
  list_reduce(list_concat([iv], list_transform(range(1, len(h) + 1), lambda j: [j])), lambda acc, jv:
    list_append(acc, least(prev[jv[1] + 1] + 1, acc[-1] + 1, prev[jv[1]] + CASE WHEN r[iv[1]] = h[jv[1]] THEN 0 ELSE 1 END))))[-1]"""


def distances(d) -> tuple[str, str]:
    """Word and character distance of reference and hypothesis; r, h are their words, v the distinct ones."""
    if d.name == "spark":
        return f"levenshtein({coded('r', 'v')}, {coded('h', 'v')})", "levenshtein(replace(reference, ' ', ''), replace(hypothesis, ' ', ''))"
    letters = lambda x: f"string_split(replace({x}, ' ', ''), '')"
    both = f"list_distinct(list_concat({letters('reference')}, {letters('hypothesis')}))"
    codes = f"array_to_string({both}, ''), array_to_string(list_transform(range(1, len({both}) + 1), lambda w: chr(w::INT)), '')"
    byte = lambda x: f"coalesce(translate(replace({x}, ' ', ''), {codes}), '')"
    return TABLE, f"levenshtein({byte('reference')}, {byte('hypothesis')})"


def pairs(d) -> str:
    """Each turn against the one before, whole texts as they are scored, as word and character tokens."""
    words, letters = distances(d)
    both = "array_distinct(concat(r, h))" if d.name == "spark" else "list_distinct(list_concat(r, h))"
    return f"""SELECT conv_id, turn, reference, hypothesis, n, {d.size('h')} AS hn, CAST({words} AS bigint) AS edits,
  CAST({letters} AS bigint) AS char_edits, length(replace(reference, ' ', '')) AS chars FROM (
  SELECT *, {both} AS v, {d.size('r')} AS n FROM (
    SELECT conv_id, turn, hypothesis, reference, {d.words('reference')} AS r, {d.words('hypothesis')} AS h FROM (
      SELECT conv_id, turn, t AS hypothesis, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM (
        SELECT conv_id, turn, {scored(d, 'text')} AS t FROM conversations) t0) t1 WHERE reference IS NOT NULL) t2) t3"""


RATE = "CASE WHEN n = 0 THEN CASE WHEN hn = 0 THEN 0e0 ELSE 1e0 END ELSE edits / cast(n AS double) END"
add("wer_rows", lambda d: f"SELECT conv_id, turn, edits, round({RATE}, 6) AS wer FROM ({pairs(d)}) p")
add("cer_rows", lambda d: f"SELECT conv_id, turn, char_edits, round(char_edits / cast(greatest(1, chars) AS double), 6) AS cer FROM ({pairs(d)}) p")
add("wer_micro_macro", lambda d: f"""
SELECT CAST(sum(edits) AS bigint) AS edits, CAST(sum(n) AS bigint) AS words, round(sum(edits) / cast(greatest(1, sum(n)) AS double), 6) AS micro, round(avg({RATE}), 6) AS macro,
       round({d.median(RATE)}, 6) AS p50, round({d.pct(RATE, 0.95)}, 6) AS p95, round(max({RATE}), 6) AS worst, {d.count_if('edits = 0')} AS exact FROM ({pairs(d)}) p""")
add("corpus_cer", lambda d: f"""
SELECT round(sum(char_edits) / cast(greatest(1, sum(chars)) AS double), 6) AS corpus_cer, round({d.median('char_edits / cast(greatest(1, chars) AS double)')}, 6) AS median_cer,
       round(avg(CASE WHEN char_edits <= 0.2e0 * greatest(1, chars) THEN 1e0 ELSE 0e0 END), 6) AS good_share, {d.count_if("hypothesis IS NULL")} AS missing, {d.count_if("hypothesis = ''")} AS empty
FROM ({pairs(d)}) p""")
add("error_counts", lambda d: f"SELECT conv_id, CAST(sum(edits) AS bigint) AS word_errors, CAST(sum(n) AS bigint) AS words, CAST(sum(char_edits) AS bigint) AS char_errors, CAST(sum(chars) AS bigint) AS chars FROM ({pairs(d)}) p GROUP BY conv_id")

# ---- intervals and tests -------------------------------------------------------------------------

add("wilson_clipped", lambda d: """
SELECT source, n, k, round(greatest(0e0, (p + z / (2 * n) - m) / (1 + z / n)), 4) AS low, round(least(1e0, (p + z / (2 * n) + m) / (1 + z / n)), 4) AS high FROM (
  SELECT *, 1.959963984540054e0 * sqrt((p * (1 - p) + z / (4 * n)) / n) AS m FROM (
    SELECT source, count(*) AS n, CAST(sum(quality) AS bigint) AS k, avg(CAST(quality AS double)) AS p, 1.959963984540054e0 * 1.959963984540054e0 AS z
    FROM documents JOIN labels USING (doc_id) GROUP BY source) a) b""")

add("latency_failures_infinite", lambda d: f"""
SELECT k, n, finite, round(mean, 6) AS mean, CASE WHEN up = {d.infinity()} OR lo = up THEN up ELSE round(lo + (up - lo) * (0.9e0 * (n - 1) - floor(0.9e0 * (n - 1))), 6) END AS p90 FROM (
  SELECT k, max(n) AS n, {d.count_if(f'v < {d.infinity()}')} AS finite, avg(CASE WHEN v < {d.infinity()} THEN v END) AS mean,
         max(CASE WHEN i = floor(0.9e0 * (n - 1)) THEN v END) AS lo, max(CASE WHEN i = ceil(0.9e0 * (n - 1)) THEN v END) AS up FROM (
    SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v, event_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM (
      SELECT user_id % 40 AS k, event_id, CASE WHEN event_id % 13 = 0 OR user_id % 40 = 5 THEN {d.infinity()} ELSE value END AS v FROM events) x) y GROUP BY k) z""")

add("mcnemar_exact", lambda d: f"""
WITH x AS (SELECT d.lang, count(*) AS planned, {d.count_if('b AND NOT a')} AS before_only, {d.count_if('a AND NOT b')} AS after_only FROM (
  SELECT lang, n_chars > 600 AS b, n_chars > 500 AND doc_id % 4 <> 0 AS a FROM documents) d GROUP BY d.lang)
SELECT lang, planned, before_only, after_only, round(CASE WHEN before_only + after_only = 0 THEN 1e0 ELSE least(1e0, 2 * """ + (
    """aggregate(slice(sequence(0, least(before_only, after_only)), 2, greatest(1, CAST(least(before_only, after_only) AS int))), named_struct('t', -(before_only + after_only) * ln(2e0), 's', exp(-(before_only + after_only) * ln(2e0))),
      (acc, i) -> named_struct('t', acc.t + ln((before_only + after_only - i + 1) / cast(i AS double)), 's', acc.s + exp(acc.t + ln((before_only + after_only - i + 1) / cast(i AS double)))), acc -> acc.s)"""
    if d.name == "spark" else
    """list_sum(list_transform(range(0, least(before_only, after_only) + 1), lambda i: exp(lgamma(before_only + after_only + 1) - lgamma(i + 1) - lgamma(before_only + after_only - i + 1) - (before_only + after_only) * ln(2e0))))"""
) + ") END, 6) AS p FROM x")

add("preference_rule", lambda d: """
WITH v AS (SELECT user_id % 20 AS listener, event_type AS item, CASE WHEN value >= 50 THEN 1e0 WHEN value >= 45 THEN 0e0 ELSE -1e0 END AS pref, user_id % 2 AS age FROM events),
g AS (SELECT age, avg(pref) AS mean, count(*) AS n FROM v GROUP BY age)
SELECT round((SELECT avg(pref) FROM v), 6) AS difference, round(min(mean), 6) AS least_group, (SELECT avg(pref) FROM v) > 0 AND min(mean) >= -0.05e0 AS preferred FROM g""")

# ---- resampling ----------------------------------------------------------------------------------
# Poisson bootstrap: in each draw a row, or a whole session, counts as often as a Poisson(1) number from a hash of both
# says. One pass, aggregated before the shuffle, for any number of rows.

DRAWS = 200


def weight(d, key: str) -> str:
    """Poisson(1) number of a key and the draw b."""
    x = d.hexint(f"substr(md5(concat({key}, '|', cast(b AS string))), 1, 7)")
    return f"CASE WHEN {x} < 98752107 THEN 0 WHEN {x} < 197504214 THEN 1 WHEN {x} < 246880267 THEN 2 WHEN {x} < 263338952 THEN 3 WHEN {x} < 267453623 THEN 4 WHEN {x} < 268276557 THEN 5 ELSE 6 END"


def draws(d) -> str:
    return f"dr AS (SELECT {d.explode(d.range('1', str(DRAWS)), 'b')})"


def interval(d, source: str, group: str) -> str:
    return f"SELECT {group}, round({d.pct('v', 0.025)}, 6) AS low, round({d.median('v')}, 6) AS median, round({d.pct('v', 0.975)}, 6) AS high FROM ({source}) q GROUP BY {group}"


LABELLED = "SELECT d.doc_id, d.source, d.lang, l.quality, d.n_chars BETWEEN 300 AND 3000 AS said FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
add("bootstrap_mean", lambda d: f"WITH {draws(d)}, x AS ({LABELLED}), w AS (SELECT lang, b, quality, {weight(d, 'cast(doc_id AS string)')} AS w FROM x CROSS JOIN dr)\n" + interval(
    d, "SELECT lang, b, sum(w * quality) / cast(sum(w) AS double) AS v FROM w GROUP BY lang, b HAVING sum(w) > 0", "lang"))
add("bootstrap_f1", lambda d: f"WITH {draws(d)}, x AS ({LABELLED}), w AS (SELECT b, quality, said, {weight(d, 'cast(doc_id AS string)')} AS w FROM x CROSS JOIN dr)\n" + interval(
    d, """SELECT 'f1' AS metric, b, 2 * sum(CASE WHEN said AND quality = 1 THEN w ELSE 0 END) / cast(greatest(1, 2 * sum(CASE WHEN said AND quality = 1 THEN w ELSE 0 END)
      + sum(CASE WHEN said AND quality = 0 THEN w ELSE 0 END) + sum(CASE WHEN NOT said AND quality = 1 THEN w ELSE 0 END)) AS double) AS v FROM w GROUP BY b""", "metric"))
add("bootstrap_sessions", lambda d: f"WITH {draws(d)}, x AS ({LABELLED}), s AS (SELECT source, count(*) AS n, sum(quality) AS k FROM x GROUP BY source), w AS (SELECT b, n, k, {weight(d, 'source')} AS w FROM s CROSS JOIN dr)\n" + interval(
    d, "SELECT 'rate' AS metric, b, sum(w * k) / cast(sum(w * n) AS double) AS v FROM w GROUP BY b HAVING sum(w * n) > 0", "metric"))
add("bootstrap_paired", lambda d: f"WITH {draws(d)}, x AS (SELECT doc_id, source, quality - CASE WHEN said THEN 1 ELSE 0 END AS gain FROM ({LABELLED}) l), w AS (SELECT b, gain, {weight(d, 'cast(doc_id AS string)')} AS w, {weight(d, 'source')} AS c FROM x CROSS JOIN dr)\n" + interval(
    d, """SELECT 'rows' AS unit, b, sum(w * gain) / cast(sum(w) AS double) AS v FROM w GROUP BY b HAVING sum(w) > 0
      UNION ALL SELECT 'sessions', b, sum(c * gain) / cast(sum(c) AS double) FROM w GROUP BY b HAVING sum(c) > 0""", "unit"))

# ---- ranks over all rows -------------------------------------------------------------------------
# A window over all rows is one task. Here values are counted first, dealt to ranges of about equal size, ranked within
# a range, and shifted by what lies in the ranges before.


def ranged(d, table: str, value: str) -> str:
    """CTE `ranks` (v, n, before): each value, its count, and the rows of lesser values."""
    if d.name == "duck":
        return f"ranks AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n AS before FROM (SELECT {value} AS v, count(*) AS n FROM {table} GROUP BY {value}) c)"
    bounds = ", ".join(f"{i / 64}" for i in range(1, 64))
    return f"""counted AS (SELECT {value} AS v, count(*) AS n FROM {table} GROUP BY {value}),
bounds AS (SELECT approx_percentile(v, array({bounds})) AS bs FROM counted),
placed AS (SELECT v, n, size(filter(bs, w -> w < v)) AS part FROM counted CROSS JOIN bounds),
parts AS (SELECT part, coalesce(sum(sum(n)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed GROUP BY part),
ranks AS (SELECT v, n, ahead + sum(n) OVER (PARTITION BY p.part ORDER BY v ROWS UNBOUNDED PRECEDING) - n AS before FROM placed p JOIN parts q ON p.part = q.part)"""


def two_ranks(d) -> str:
    a, b = ranged(d, "lineitem", "l_quantity"), ranged(d, "lineitem", "l_extendedprice")
    for name in ("counted", "bounds", "placed", "parts", "ranks"):
        b = b.replace(f"{name} AS", f"{name}2 AS").replace(f"FROM {name}", f"FROM {name}2").replace(f"JOIN {name}", f"JOIN {name}2")
    return f"WITH {a}, {b}"


add("spearman_midrank", lambda d: f"""{two_ranks(d)}
SELECT round(corr(cast(a.before + (a.n + 1) / 2e0 AS double), cast(b.before + (b.n + 1) / 2e0 AS double)), 6) AS rho
FROM lineitem l JOIN ranks a ON a.v = l.l_quantity JOIN ranks2 b ON b.v = l.l_extendedprice""")

#: Rows in order of size: all of a value's rows are ranked by id within it.
add("quantile_sample", lambda d: f"""WITH {ranged(d, 'documents', 'n_chars')}, total AS (SELECT count(*) AS n FROM documents),
p AS (SELECT x.doc_id, r.before + row_number() OVER (PARTITION BY x.n_chars ORDER BY x.doc_id) - 1 AS i FROM documents x JOIN ranks r ON r.v = x.n_chars),
b AS (SELECT doc_id, CAST(floor((i * 20 + 19) / cast(n AS double)) AS bigint) AS bucket FROM p CROSS JOIN total)
SELECT bucket, doc_id FROM (SELECT bucket, doc_id, row_number() OVER (PARTITION BY bucket ORDER BY {d.sha('cast(doc_id AS string)')}, doc_id) AS r FROM b) x WHERE r = 1""")

add("panel_two_stage", lambda d: f"""
WITH s AS (SELECT source, row_number() OVER (ORDER BY {d.sha('source')}) AS s FROM (SELECT DISTINCT source FROM documents) x)
SELECT session_id, utt_id, stage FROM (
  SELECT d.source AS session_id, d.doc_id AS utt_id, CASE WHEN s.s <= 5 THEN 1 ELSE 2 END AS stage,
         row_number() OVER (PARTITION BY d.source ORDER BY {d.sha('cast(d.doc_id AS string)')}, d.doc_id) AS r FROM documents d JOIN s ON d.source = s.source WHERE s.s <= 10) y WHERE r <= 4""")

add("class_balance", lambda d: f"""
WITH n AS (SELECT count(*) AS n FROM labels WHERE toxic = 1), h AS (SELECT doc_id, toxic, {d.sha('cast(doc_id AS string)')} AS h FROM labels),
parts AS (SELECT toxic, part, sum(sum(k)) OVER (PARTITION BY toxic ORDER BY part ROWS UNBOUNDED PRECEDING) - sum(k) AS before FROM (SELECT toxic, substr(h, 1, 2) AS part, 1 AS k FROM h) x GROUP BY toxic, part),
r AS (SELECT h.doc_id, h.toxic, p.before + row_number() OVER (PARTITION BY h.toxic, substr(h.h, 1, 2) ORDER BY h.h, h.doc_id) AS r FROM h JOIN parts p ON p.toxic = h.toxic AND p.part = substr(h.h, 1, 2))
SELECT doc_id, toxic FROM r CROSS JOIN n WHERE r.r <= n.n""")

# ---- series by user: as many tasks as users ------------------------------------------------------

add("session_gap", lambda d: f"""
WITH a AS (SELECT user_id, event_id, {d.seconds('ts')} AS s FROM events),
b AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 86400 THEN 0 ELSE 1 END AS fresh FROM a),
c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS session FROM b)
SELECT user_id, session, count(*) AS n, round(max(s) - min(s), 3) AS seconds FROM c GROUP BY user_id, session""")
add("trailing_range", lambda d: f"""
WITH a AS (SELECT event_id, user_id, {d.seconds('ts')} AS s FROM events)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM a""")
add("debounce_runs", lambda d: f"""
WITH a AS (SELECT user_id, event_id, {d.seconds('ts')} AS s, value >= 50 AS high FROM events),
b AS (SELECT *, CASE WHEN high = lag(high) OVER (PARTITION BY user_id ORDER BY s, event_id) THEN 0 ELSE 1 END AS fresh FROM a),
c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM b)
SELECT user_id, run, count(*) AS n FROM c WHERE high GROUP BY user_id, run HAVING count(*) >= 3""")

add("percentile_lower", lambda d: f"""
WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY event_type, value), t AS (SELECT event_type, sum(n) AS total FROM c GROUP BY event_type),
p AS (SELECT c.*, floor(value / 4) AS part FROM c), parts AS (SELECT event_type, part, sum(sum(n)) OVER (PARTITION BY event_type ORDER BY part ROWS UNBOUNDED PRECEDING) - sum(n) AS before FROM p GROUP BY event_type, part),
r AS (SELECT p.event_type, p.value, q.before + sum(p.n) OVER (PARTITION BY p.event_type, p.part ORDER BY p.value ROWS UNBOUNDED PRECEDING) AS upto, p.n FROM p JOIN parts q ON p.event_type = q.event_type AND p.part = q.part)
SELECT r.event_type, round(min(r.value), 6) AS p90_lower FROM r JOIN t ON r.event_type = t.event_type WHERE r.upto > floor(0.9e0 * (t.total - 1)) GROUP BY r.event_type""")

# ---- signals as arrays ---------------------------------------------------------------------------
# Frames are the vectors of `embeddings`: native folds over arrays, in double precision.

NUM = "SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL"
add("frame_energy", lambda d: f"""
SELECT vec_id, round(10 * log10({'aggregate(v, 0e0, (a, x) -> a + cast(x AS double) * cast(x AS double))' if d.name == 'spark' else 'list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))'} / {d.size('v')} + 1e-12), 5) AS db FROM ({NUM}) x""")
add("frame_zcr", lambda d: f"""
SELECT vec_id, round({"aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (a, b) -> CASE WHEN (a >= 0) <> (b >= 0) THEN 1 ELSE 0 END), 0, (a, x) -> a + x)" if d.name == "spark" else
  "list_sum(list_transform(range(1, len(v)), lambda i: CASE WHEN (v[i] >= 0) <> (v[i + 1] >= 0) THEN 1 ELSE 0 END))"} / cast({d.size('v')} - 1 AS double), 6) AS zcr FROM ({NUM}) x""")
add("frame_snr", lambda d: f"""
WITH e AS (SELECT label, 10 * log10({'aggregate(v, 0e0, (a, x) -> a + cast(x AS double) * cast(x AS double))' if d.name == 'spark' else 'list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))'} / {d.size('v')} + 1e-12) + vec_id % 7 AS db FROM ({NUM}) x)
SELECT label, round(CASE WHEN count(*) < 4 THEN 0e0 ELSE {d.pct('db', 0.9)} - {d.pct('db', 0.1)} END, 4) AS snr_db FROM e GROUP BY label""")
add("energy_rule", lambda d: f"""
WITH e AS (SELECT vec_id, label, 10 * log10({'aggregate(v, 0e0, (a, x) -> a + cast(x AS double) * cast(x AS double))' if d.name == 'spark' else 'list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))'} / {d.size('v')} + 1e-12) + vec_id % 7 AS db FROM ({NUM}) x),
f AS (SELECT label, {d.pct('db', 0.1)} AS floor_ FROM e GROUP BY label)
SELECT e.vec_id, e.db > f.floor_ + 3 AS speech FROM e JOIN f ON e.label = f.label""")
add("framing", lambda d: f"""
SELECT vec_id, CAST(i AS bigint) AS frame, {d.glued(d.map(d.part('v', 'i * 8 + 1', '16'), "CAST(round(cast(w AS double) * 1000) AS bigint)"), ',')} AS samples FROM (
  SELECT vec_id, v, {d.explode(d.range('0', f"CAST(floor(({d.size('v')} - 16) / 8) AS int)"), 'i')} FROM ({NUM}) x) y""")
add("clip_cut", lambda d: f"""
SELECT vec_id, {d.glued(d.map(d.range('place - 8', 'place + 7'), f"CASE WHEN w < 1 OR w > {d.size('v')} THEN 0 ELSE CAST(round(cast({d.at('v', 'greatest(1, least(w, ' + d.size('v') + '))')} AS double) * 1000) AS bigint) END"), ',')} AS clip
FROM (SELECT vec_id, v, CAST(vec_id % 70 AS int) AS place FROM ({NUM}) x) y""")
add("sample_frames", lambda d: f"""
WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)
SELECT user_id, CAST(floor(seq * 320 / 512e0) AS bigint) AS frame, count(*) AS messages, CAST(min(seq) * 320 AS bigint) AS first_sample FROM m GROUP BY user_id, floor(seq * 320 / 512e0)""")
add("window_context", lambda d: f"""
WITH e AS (SELECT vec_id, label, cast({d.at('v', '1')} AS double) AS x FROM ({NUM}) y)
SELECT vec_id, round(avg(x) OVER w, 5) AS mean, round(stddev_pop(x) OVER w, 4) AS sd, round(max(x) OVER w, 5) AS top FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
add("turn_levels", lambda d: f"""
WITH {segments(d)}, v AS (SELECT conv_id, speaker, sqrt(avg((stop - start) * (stop - start))) AS rms FROM seg GROUP BY conv_id, speaker)
SELECT conv_id, round(20 * log10(greatest(max(CASE WHEN speaker = 'user' THEN rms END), 1e-8) / greatest(max(CASE WHEN speaker <> 'user' THEN rms END), 1e-8)), 3) AS snr_db FROM v GROUP BY conv_id""")
