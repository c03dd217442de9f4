"""Projections, predicates, buckets, text and scalar rules over rows of a speech corpus, as native expressions."""

from __future__ import annotations

from .catalogue import ADJACENT, PAIRS, UTTERANCES, segments
from .sql import add

# Latin letters of the test texts and the letters that stand for them in a Persian stand-in.
LATIN, PERSIAN = "abcdefghiklmnoprstuvwz", "ابثدهفگحیکلمنوپرسةأوقز"
#: Every second text in Persian letters.
FA = f"SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 2 = 0 THEN translate(lower(text), '{LATIN}', '{PERSIAN}') ELSE text END AS text FROM documents"

# ---- keys, channels and defaults -----------------------------------------------------------------

add("coalesced_keys", lambda d: """
SELECT doc_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''), 'unknown') AS first_key FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END AS a, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS b,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE cast(n_chars AS string) END AS c FROM documents) x""")

add("channel_of", lambda d: """
SELECT doc_id, CASE WHEN trim(coalesce(channel, '')) <> '' THEN trim(channel)
  WHEN session_id LIKE '%/%' THEN split_part(session_id, '/', 1) ELSE 'unknown' END AS channel FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN ' ' END AS channel,
         CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN NULL ELSE concat(source, '/', cast(doc_id AS string)) END AS session_id FROM documents) x""")

add("metadata_defaults", lambda d: """
SELECT source, count(*) AS n, CAST(sum(CASE WHEN license IS NULL THEN 1 ELSE 0 END) AS bigint) AS license_set,
       CAST(sum(CASE WHEN status = 'legacy' THEN 1 ELSE 0 END) AS bigint) AS status_changed,
       CAST(sum(CASE WHEN license IS NULL OR status = 'legacy' THEN 1 ELSE 0 END) AS bigint) AS rows_changed,
       min(coalesce(license, 'unverified')) AS least_license, max(CASE WHEN status = 'legacy' THEN 'pending' ELSE status END) AS top_status FROM (
  SELECT source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('l-', lang) END AS license, CASE WHEN doc_id % 5 = 0 THEN 'legacy' ELSE 'approved' END AS status
  FROM documents) x GROUP BY source""")

add("relative_offsets", lambda d: f"""
WITH {segments(lambda: 0)}, o AS (
  SELECT conv_id, turn, start, stop, min(start) OVER (PARTITION BY conv_id) AS base, CASE WHEN turn % 5 = 0 THEN NULL ELSE start END AS given FROM seg)
SELECT conv_id, turn, round(greatest(0e0, coalesce(given, start) - base), 6) AS offset_start,
       round(greatest(0e0, coalesce(given + (stop - start), stop) - base), 6) AS offset_stop FROM o""")

# ---- eligibility ---------------------------------------------------------------------------------

add("clip_reasons", lambda d: f"""
SELECT doc_id, CASE WHEN NOT {d.finite('duration')} THEN 'invalid_duration' WHEN duration < 1 OR duration > 20 THEN 'duration'
  WHEN language_status IN ('no_persian_speech', 'no_speech', 'language_uncertain') THEN concat('lid:', language_status)
  WHEN length(t) < 4 OR {d.like('t', r'^(?i:موسیقی|music|applause|\[.*\])$')} THEN 'music'
  WHEN letters = 0 OR arabic < 0.35e0 * letters THEN 'not_persian' WHEN {d.size(d.words('t'))} < 3 THEN 'short_text'
  WHEN snr IS NOT NULL AND NOT {d.finite('snr')} THEN 'invalid_snr' WHEN snr < 3 THEN 'low_snr' ELSE 'ok' END AS reason FROM (
  SELECT *, length({d.replace('t', r'[^\p{L}\x{0600}-\x{06FF}]', '')}) AS letters, length({d.replace('t', r'[^\x{0600}-\x{06FF}]', '')}) AS arabic FROM (
    SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN {d.nan()} ELSE n_chars / 150e0 END AS duration,
           CASE WHEN doc_id % 89 = 0 THEN '[music]' WHEN doc_id % 83 = 0 THEN 'abc' ELSE trim(text) END AS t,
           CASE WHEN doc_id % 41 = 0 THEN 'no_speech' WHEN doc_id % 43 = 0 THEN 'language_uncertain' ELSE 'ok' END AS language_status,
           CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN {d.nan()} ELSE (doc_id % 40) / 4e0 END AS snr FROM ({FA}) f) x) y""")

WINDOW = """SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 4 <> 1 END AS verified, conv_id % 4 <> 0 AS has_verified,
  CASE WHEN conv_id % 7 = 0 THEN 'partial' ELSE 'complete' END AS alignment, conv_id % 3 <> 0 AS has_alignment, conv_id % 5 = 0 AS reviewed,
  CASE WHEN conv_id % 10 = 0 THEN true WHEN conv_id % 5 = 0 THEN NULL END AS human, conv_id % 6 <> 0 AS authorized,
  count(*) AS turns, count(DISTINCT speaker) AS speakers FROM seg GROUP BY conv_id"""
IS_TRUE = "coalesce({}, false)"

add("window_eligibility", lambda d: f"""
WITH {segments(d)} SELECT conv_id, CASE WHEN has_verified AND NOT coalesce(verified, false) THEN 'not_verified_multi_speaker'
  WHEN has_alignment AND alignment <> 'complete' THEN 'reference_alignment_incomplete'
  WHEN reviewed AND NOT coalesce(human, false) THEN 'manual_qa_rejected' WHEN speakers < 2 THEN 'not_multi_speaker' ELSE 'ok' END AS reason FROM ({WINDOW}) x""")

add("recorded_eligibility", lambda d: f"""
WITH {segments(d)} SELECT conv_id FROM ({WINDOW}) x
WHERE coalesce(verified, false) AND alignment = 'complete' AND authorized AND NOT (reviewed AND NOT coalesce(human, false))""")

add("panel_eligibility", lambda d: f"""
SELECT doc_id FROM (
  SELECT doc_id, lang, n_chars / 150e0 AS duration, {d.size(d.words('text'))} AS words, length({d.replace('text', r'[^\p{L}]', '')}) AS letters,
         length({d.replace('text', r'[^\x{0600}-\x{06FF}]', '')}) AS arabic FROM ({FA}) f) x
WHERE lang IN ('en', 'de') AND duration BETWEEN 1 AND 20 AND words BETWEEN 2 AND 80 AND letters > 0 AND arabic >= 0.8e0 * letters""")

RIGHTS = """SELECT doc_id, doc_id % 3 = 0 AS license_verified, CASE WHEN doc_id % 6 = 0 THEN 'unknown' ELSE 'cc-by' END AS license, doc_id % 4 <> 0 AS has_review,
  CASE WHEN doc_id % 2 = 0 THEN 'explicit_license' ELSE 'supervisor_research' END AS basis, doc_id % 5 <> 0 AS complete,
  CASE WHEN doc_id % 7 = 0 THEN 'pending' ELSE 'approved' END AS status, doc_id % 11 <> 0 AS training, doc_id % 8 <> 1 AS research, doc_id % 9 = 0 AS redistribution,
  CASE WHEN doc_id % 13 = 0 THEN '2024-02-30' WHEN doc_id % 17 = 0 THEN '' ELSE concat('2024-0', cast(1 + doc_id % 9 AS string), '-1', cast(doc_id % 10 AS string)) END AS approved_on
  FROM documents"""

add("rights_predicates", lambda d: f"""
SELECT doc_id, verified, verified OR (research AND reviewed AND basis = 'supervisor_research' AND NOT license_verified AND NOT redistribution) AS training_authorized FROM (
  SELECT *, license_verified AND license NOT IN ('unknown', '') AND (NOT has_review OR (reviewed AND basis = 'explicit_license')) AS verified FROM (
    SELECT *, has_review AND complete AND status = 'approved' AND training AND try_cast(approved_on AS date) IS NOT NULL AS reviewed FROM ({RIGHTS}) r) x) y""")

add("iso_date_validity", lambda d: f"""
SELECT try_cast(approved_on AS date) IS NOT NULL AS valid, count(*) AS n FROM ({RIGHTS}) r GROUP BY try_cast(approved_on AS date) IS NOT NULL""")

add("candidate_reasons", lambda d: f"""
SELECT page_id, reason <> 'likely_monologue_excluded_by_default' AS candidate, reason FROM (
  SELECT page_id, CASE WHEN prior THEN 'podcast_prior_needs_diarization' WHEN prior IS NULL THEN 'mixed_channel_needs_diarization'
    WHEN {d.like('lower(title)', 'interview|talk|guest|an|on')} THEN 'interview_title_needs_diarization' ELSE 'likely_monologue_excluded_by_default' END AS reason FROM (
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS prior, {d.first_group('html', '<title>([^<]*)</title>')} AS title FROM pages) x) y""")

add("waiver_match", lambda d: """
SELECT doc_id FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'research-v1' ELSE 'none' END AS policy, substr(md5(cast(doc_id % 3 AS string)), 1, 8) AS digest,
         doc_id % 5 <> 0 AS waived, CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 = 1 THEN false END AS human,
         CASE WHEN doc_id % 11 = 0 THEN true END AS human_label FROM documents) x
WHERE policy = 'research-v1' AND digest = substr(md5('0'), 1, 8) AND waived AND NOT coalesce(human, false) AND NOT coalesce(human_label, false)""")

add("number_checks", lambda d: f"""
SELECT kind, count(*) AS n, {d.count_if(d.finite('x'))} AS finite, {d.count_if(d.finite('x') + ' AND x >= 0')} AS accepted FROM (
  SELECT doc_id % 6 AS kind, CASE doc_id % 6 WHEN 0 THEN {d.nan()} WHEN 1 THEN {d.infinity()} WHEN 2 THEN -1e0 * n_chars WHEN 3 THEN NULL ELSE n_chars / 7e0 END AS x
  FROM documents) v GROUP BY kind""")

# ---- labels and buckets --------------------------------------------------------------------------

add("interaction_full", lambda d: f"""
WITH {segments(d)}, {ADJACENT}, p AS (
  SELECT conv_id, turn, start, stop, next_start, next_stop, next_start < least(stop, next_stop) AS during,
         {d.some(d.array('0e0', '40e0', '95e0'), 'least(greatest(stop, next_stop), w + 3e0) > greatest(least(start, next_start), w)')} AS known
  FROM adj WHERE next_speaker IS NOT NULL AND speaker <> next_speaker)
SELECT conv_id, turn, CASE WHEN NOT during AND NOT known THEN 'none' WHEN NOT during THEN 'overlap_unattributed'
  WHEN next_stop - next_start <= 1.2e0 AND next_stop <= stop + 0.2e0 THEN 'backchannel' ELSE 'interrupt' END AS label FROM p""")

add("event_kinds", lambda d: f"""
WITH {segments(d)}, {ADJACENT} SELECT conv_id, turn, CASE
  WHEN stop > next_start + 0.15e0 THEN CASE WHEN next_stop - next_start <= 1.5e0 THEN 'short_response' ELSE 'overlap_onset' END
  WHEN next_start - stop BETWEEN 0e0 AND 1e0 THEN CASE WHEN next_stop - next_start <= 1.5e0 THEN 'short_response' ELSE 'turn_change' END ELSE 'none' END AS kind
FROM adj WHERE next_speaker <> speaker""")

add("length_buckets", lambda d: f"""
WITH {segments(d)} SELECT speaker, CASE WHEN stop - start <= 3 THEN 'short' WHEN stop - start <= 10 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n
FROM seg GROUP BY speaker, CASE WHEN stop - start <= 3 THEN 'short' WHEN stop - start <= 10 THEN 'medium' ELSE 'long' END""")

#: A noise level per pair: the ratio of two levels in decibels; none where either is missing.
NOISE = """CASE WHEN snr IS NULL THEN 'unestimated' WHEN snr <= 20 THEN 'background-noisy' WHEN snr <= 30 THEN 'background-moderate' ELSE 'background-clean' END"""
add("noise_buckets", lambda d: f"""
SELECT channel, {NOISE} AS noise, count(*) AS n FROM (
  SELECT channel, 20e0 * log10(greatest(hours * 100, 1e-8) / greatest(CASE WHEN pair_id % 13 = 0 THEN NULL ELSE 1 + pair_id % 7 END, 1e-8)) AS raw,
         CASE WHEN pair_id % 13 = 0 THEN NULL ELSE 20e0 * log10(greatest(hours * 100, 1e-8) / (1 + pair_id % 7)) END AS snr FROM ({PAIRS}) p) x
GROUP BY channel, {NOISE}""")

add("match_ratios", lambda d: f"""
WITH {segments(d)} SELECT a.conv_id, a.turn AS one, b.turn AS two,
  round(greatest(0e0, least(a.stop, b.stop) - greatest(a.start, b.start)) / least(a.stop - a.start, b.stop - b.start), 6) AS ratio
FROM seg a JOIN seg b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.stop > a.start AND b.stop > b.start""")

# ---- ids, names and texts ------------------------------------------------------------------------

add("stable_ids", lambda d: f"""
WITH {segments(d)} SELECT conv_id, turn, concat('ev-', substr({d.sha("concat(cast(conv_id AS string), '|', key, '|', speaker)")}, 1, 20)) AS event_id FROM (
  SELECT *, concat(cast(CAST(floor(start) AS bigint) AS string), '.', lpad(cast(CAST(floor((start - floor(start)) * 1000) AS bigint) AS string), 3, '0')) AS key FROM seg) s""")

add("safe_names", lambda d: f"""
SELECT page_id, coalesce(nullif(substr(trim({d.replace('url', '[^A-Za-z0-9_.-]+', '-')}, '-'), 1, 36), ''), 'session') AS name FROM pages""" if d.name == "duck" else f"""
SELECT page_id, coalesce(nullif(substr(trim(BOTH '-' FROM {d.replace('url', '[^A-Za-z0-9_.-]+', '-')}), 1, 36), ''), 'session') AS name FROM pages""")

add("escaped_names", lambda d: f"""
SELECT page_id, {d.replace('url', r'([*?\[\]{}\\])', r'\\\1' if d.name == 'duck' else r'\\\\$1')} AS literal, {d.replace('url', r'[/\\:]+', '_')} AS file_name FROM pages""")

add("response_keys", lambda d: f"""
SELECT conv_id, {d.sha("concat_ws(" + ("char(0)" if d.name == "spark" else "chr(0)") + ", 'model', cast(conv_id AS string), min(text))")} AS cache_key FROM conversations GROUP BY conv_id""")

add("stable_splits", lambda d: f"""
SELECT source, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT source, (({d.hexint('substr(h, 1, 8)')} % 100) * 96 + {d.hexint('substr(h, 9, 8)')}) % 100 AS bucket FROM (
    SELECT source, {d.sha("concat('17:', source)")} AS h FROM documents GROUP BY source) x) y""")

add("script_flags", lambda d: f"""
SELECT doc_id, round(ratio, 6) AS ratio, trim(text) <> '' AND ratio >= 0.35e0 AS persian FROM (
  SELECT doc_id, text, CASE WHEN letters = 0 THEN 0e0 ELSE arabic / cast(letters AS double) END AS ratio FROM (
    SELECT doc_id, text, length({d.replace('text', r'[^\p{L}\x{0600}-\x{06FF}]', '')}) AS letters, length({d.replace('text', r'[^\x{0600}-\x{06FF}]', '')}) AS arabic FROM ({FA}) f) x) y""")

add("music_only", lambda d: f"""
SELECT doc_id, length(t) < 4 OR {d.like('t', r'^(?i:موسیقی|music|applause|\[.*\])$')} AS music FROM (
  SELECT doc_id, trim(CASE doc_id % 9 WHEN 0 THEN ' [intro] ' WHEN 1 THEN 'MUSIC' WHEN 2 THEN 'music on' WHEN 3 THEN ' ab ' ELSE text END) AS t FROM documents) x""")

# Letters of Arabic keyboards and the Persian ones that scoring takes for them; digits of both scripts.
FOLD_FROM, FOLD_TO = "يىكةۀؤإأئ۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "ییکههواای01234567890123456789"


def scored(d, x: str) -> str:
    """Text as error rates see it: no diacritics or joiners, folded letters and digits, punctuation as blanks, lower case."""
    plain = d.replace(x, r"[\x{064B}-\x{0670}\x{065F}\x{0640}\x{200C}\x{200D}]", "")
    spaced = d.replace(f"translate({plain}, '{FOLD_FROM}', '{FOLD_TO}')", r"[^\p{L}\p{N}\p{M}\s]|_", " ")
    return f"lower(trim({d.replace(spaced, r'[ \t\n\r]+', ' ')}))"


add("score_normalize", lambda d: f"""
SELECT doc_id, {scored(d, 'text')} AS text FROM (
  SELECT doc_id, translate(CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'ـِ') WHEN doc_id % 3 = 1 THEN replace(text, 'n', '‌ن۴') ELSE text END, '_xyz', ' كيى') AS text FROM ({FA}) f) x""")

add("tokenize_zwnj", lambda d: f"""
SELECT doc_id, CAST({d.size(d.words("replace(text, '‌', ' ')"))} AS bigint) AS tokens, CAST(length({d.replace('text', r'[\s\x{200C}]+', '')}) AS bigint) AS characters FROM (
  SELECT doc_id, replace(text, 'th', '‌') AS text FROM documents) x""")

add("last_word_gate", lambda d: f"""
SELECT conv_id, turn, w AS last_word, coalesce(w IN ('and', 'or', 'the', 'of', 'und', 'et', 'y'), false) AS goes_on FROM (
  SELECT conv_id, turn, {d.at('ws', d.size('ws'))} AS w FROM (
    SELECT conv_id, turn, {d.words(d.replace('lower(text)', r'[^\p{L}\p{N}\s]', ' '))} AS ws FROM conversations) x WHERE {d.size('ws')} > 0) y""")

add("pause_marks", lambda d: f"""
SELECT conv_id, turn, concat(trim({d.replace(d.replace(d.replace('text', r'[ \t\n\r؟?.!]+$', ''), '[،,؟?.!؛:]', ' '), r'[ \t\n\r]+', ' ')}), CASE WHEN {d.like('text', r'[؟?][ \t\n\r]*$')} THEN '?' ELSE '' END) AS line
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat(text, ' ?') ELSE text END AS text FROM conversations) x""")

add("json_objects", lambda d: f"""
SELECT event_id, cast({d.json('body', 'k')} AS bigint) AS k FROM (
  SELECT event_id, {d.first_group('reply', r'(?s)(\{.*\})')} AS body FROM (
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN event_id % 3 = 1 THEN props ELSE concat('result: ', props) END AS reply FROM events) x) y""")

# Words by which a listener only shows that they listen.
LISTENER = "'ja', 'yes', 'oui', 'si', 'the', 'de', 'la', 'un'"
add("listener_tokens", lambda d: f"""
SELECT conv_id, turn, {d.size('ws')} > 0 AND {d.size(d.filter('ws', f'NOT w IN ({LISTENER})'))} = 0 AS listener_only, CAST({d.size(d.filter('ws', f'NOT w IN ({LISTENER})'))} AS bigint) AS content
FROM (SELECT conv_id, turn, {d.words(scored(d, 'text'))} AS ws FROM conversations) x""")


def close(d, a: str, b: str) -> str:
    """Whether token a can be word b as it was heard: equal, cut at an edge, or one edit apart; ASCII words."""
    short = f"least(length({a}), length({b}))"
    edges = " OR ".join(f(x, y) for f in (d.prefix, d.suffix) for x, y in ((a, b), (b, a)))
    return f"({a} = {b} OR ({short} >= 3 AND ({edges} OR (abs(length({a}) - length({b})) <= 1 AND levenshtein({a}, {b}) = 1))))"


def strictly_close(d, a: str, b: str) -> str:
    """The stricter of the two rules: equal, or one edit apart for words of four letters or more."""
    return f"({a} = {b} OR (least(length({a}), length({b})) >= 4 AND abs(length({a}) - length({b})) <= 1 AND levenshtein({a}, {b}) = 1))"


def echoes(d, near) -> str:
    """Tokens of a turn that are no words of the turn before, by a rule for words as they were heard."""
    return f"""
WITH t AS (SELECT conv_id, turn, {d.words(d.replace('lower(text)', '[^a-z ]', ''))} AS ws FROM conversations),
u AS (SELECT conv_id, turn, {'array_distinct(ws)' if d.name == 'spark' else 'list_distinct(ws)'} AS ds FROM t),
x AS (SELECT conv_id, turn, {d.explode('ws', 'token')} FROM t),
a AS (SELECT conv_id, turn, {d.explode('ds', 'token')} FROM u), b AS (SELECT conv_id, turn + 1 AS turn, {d.explode('ds', 'word')} FROM u)
SELECT x.conv_id, x.turn, x.token, count(*) AS places FROM x LEFT JOIN (
  SELECT DISTINCT a.conv_id, a.turn, a.token FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND {near(d, 'a.token', 'b.word')}) e
ON x.conv_id = e.conv_id AND x.turn = e.turn AND x.token = e.token WHERE e.token IS NULL GROUP BY x.conv_id, x.turn, x.token"""


add("fuzzy_echo", lambda d: echoes(d, close))
add("strict_echo", lambda d: echoes(d, strictly_close))

# ---- clocks, arrays, maps ------------------------------------------------------------------------

add("clock_parse", lambda d: f"""
SELECT doc_id, round(coalesce(try_cast(c AS double), CASE
  WHEN {d.some(d.split("replace(c, ',', '.')", ':'), 'try_cast(w AS double) IS NULL')} THEN 0e0
  WHEN {d.size(d.split('c', ':'))} = 3 THEN 3600 * cast({d.at('p', '1')} AS double) + 60 * cast({d.at('p', '2')} AS double) + cast({d.at('p', '3')} AS double)
  WHEN {d.size(d.split('c', ':'))} = 2 THEN 60 * cast({d.at('p', '1')} AS double) + cast({d.at('p', '2')} AS double)
  ELSE cast({d.at('p', d.size('p'))} AS double) END), 6) AS seconds FROM (SELECT doc_id, c, {d.map(d.split("replace(c, ',', '.')", ':'), 'try_cast(w AS double)')} AS p FROM (
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN cast(n_chars AS string) WHEN 1 THEN concat('1:', cast(doc_id % 60 AS string), ':07,5')
      WHEN 2 THEN concat(cast(doc_id % 60 AS string), ':30.25') WHEN 3 THEN 'x:10' WHEN 4 THEN '12,5' ELSE '0' END AS c FROM documents) x) y""")

add("zipped_spans", lambda d: f"""
SELECT conv_id, round(max(stop) - min(start), 6) AS timeline, count(*) AS valid FROM (
  SELECT conv_id, {d.at('s', 'i')} AS start, {d.at('e', 'i')} AS stop FROM (
    SELECT conv_id, s, e, {d.explode(d.range('1', 'n'), 'i')} FROM (
      SELECT conv_id, count(*) AS n, {d.gathered('CASE WHEN turn % 6 = 5 THEN start + 100 ELSE start END', 'turn')} AS s, {d.gathered('stop', 'turn')} AS e FROM seg GROUP BY conv_id) g) z) v
WHERE stop > start GROUP BY conv_id""".replace("SELECT conv_id, round", f"WITH {segments(d)} SELECT conv_id, round", 1))

add("set_operations", lambda d: f"""
SELECT source, {d.glued("array_sort(array_except(a, b))" if d.name == "spark" else "list_sort(list_filter(a, lambda w: NOT list_contains(b, w)))", ',')} AS only_a,
       {d.glued("array_sort(array_intersect(a, b))" if d.name == "spark" else "list_sort(list_filter(a, lambda w: list_contains(b, w)))", ',')} AS both,
       {"size(array_except(a, b)) = 0" if d.name == "spark" else "len(list_filter(a, lambda w: NOT list_contains(b, w))) = 0"} AS subset FROM (
  SELECT source, {"collect_set" if d.name == "spark" else "list_distinct(list"}(lang){"" if d.name == "spark" else ")"} AS a,
         {"collect_set" if d.name == "spark" else "list_distinct(list"}(CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'en' END){"" if d.name == "spark" else ")"} AS b FROM documents GROUP BY source) x""")

add("any_all", lambda d: f"""
SELECT source, {d.some('q', 'w = 1')} AS any_good, NOT {d.some('q', 'w IS NULL OR w <> 1')} AS all_good FROM (
  SELECT source, {d.gathered('l.quality', 'd.doc_id')} AS q FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id GROUP BY source) x""")

add("counter_maps", lambda d: """
SELECT source, to_json(map_from_entries(array_sort(collect_list(struct(lang, n))))) AS counts FROM (
  SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) x GROUP BY source""" if d.name == "spark" else """
SELECT source, '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS counts FROM (
  SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) x GROUP BY source""")

add("canonical_json", lambda d: f"""
SELECT doc_id, {d.sha("to_json(named_struct('doc_id', doc_id, 'lang', lang, 'source', source))" if d.name == "spark" else "json_object('doc_id', doc_id, 'lang', lang, 'source', source)::VARCHAR")} AS digest FROM documents""")

add("struct_extremes", lambda d: """
SELECT lang, min(struct(n_chars, doc_id)).doc_id AS shortest, max(struct(n_chars, -doc_id)).n_chars AS longest FROM documents GROUP BY lang""" if d.name == "spark" else """
SELECT lang, arg_min(doc_id, (n_chars, doc_id)) AS shortest, max(n_chars) AS longest FROM documents GROUP BY lang""")
