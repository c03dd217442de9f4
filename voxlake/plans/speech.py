"""Romanised phonemes, and two sample arrays on one timeline."""

from __future__ import annotations

from voxlake.functions.transducer import romanised

from .sql import add

#: Texts as if they were phonemes: two sequences, accented letters as rarer symbols, blanks between words.
PHONES = "translate(replace(replace(lower(text), 'sh', 'dʒ'), 'th', 'tʃ'), 'éèêëàâäáíîïóôöúùûüçñß' || chr(10), 'ɛəɪɜɑɒʌaiɐeɔoouʊuuʃŋθ ')"

add("romanised_words", lambda d: f"SELECT doc_id, words, words IS NOT NULL AS mapped FROM (SELECT doc_id, {romanised(d, PHONES)} AS words FROM documents) x")


def _side(d, v: str, start: str) -> str:
    """Sample i of an array that begins at sample `start` of the timeline, zero around it."""
    return f"coalesce({d.at(v, f'CASE WHEN w > {start} AND w <= {start} + {d.size(v)} THEN w - {start} END')}, 0)"


def overlay(d, left: str, left_from: str, right: str, right_from: str) -> dict[str, str]:
    """The two channels of a timeline that ends with the later array."""
    last = f"greatest({left_from} + {d.size(left)}, {right_from} + {d.size(right)})"
    every = d.range("1", f"CAST({last} AS int)")
    return {"left_samples": d.map(every, _side(d, left, left_from)), "right_samples": d.map(every, _side(d, right, right_from))}


def stereo(d) -> str:
    """Each vector and the next one of its label as two speakers' samples; the second begins somewhere within or after the first."""
    level = lambda v: d.map(v, "CAST(round(cast(w AS double) * 1000) AS bigint)")
    sides = ", ".join(f"{d.glued(x, ' ')} AS {name}" for name, x in overlay(d, "a", "af", "b", "bf").items())
    return f"""
WITH n AS (SELECT vec_id, label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT vec_id, {level('a')} AS a, {level('b')} AS b, CAST(CASE WHEN vec_id % 3 = 0 THEN 5 ELSE 0 END AS int) AS af, CAST(vec_id % 90 AS int) AS bf FROM n WHERE b IS NOT NULL)
SELECT vec_id, {sides} FROM p"""


add("stereo_overlay", stereo)


#: Samples of a level window, and windows that are taken of speech and of the rest at most, evenly spaced; both are the measure itself.
LEVEL, LEVELS = 4, 32


def snr(d) -> str:
    """Speech against background, by user: the median level of windows in the middle of merged turns and of the gaps between them.

    A user's events are samples; every ninth one begins a turn of up to eight samples. Without a window of either kind there is no estimate.
    """
    linspace = d.explode(d.range("0", str(LEVELS - 1)), "i")
    return f"""
WITH s AS (SELECT user_id, n, CASE WHEN n % 5 = 0 THEN value / 10 ELSE value / 100 END AS x, value, event_id FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events WHERE value IS NOT NULL) e),
len AS (SELECT user_id, count(*) AS total FROM s GROUP BY user_id),
t AS (SELECT s.user_id, n AS start, least(total, n + 2 + CAST(floor(value / 16) AS bigint)) AS stop FROM s JOIN len ON s.user_id = len.user_id WHERE event_id % 9 = 0),
u AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM t),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM u),
speech AS (SELECT user_id, min(start) AS start, max(stop) AS stop FROM v GROUP BY user_id, island),
gaps AS (SELECT user_id, coalesce(lag(stop) OVER (PARTITION BY user_id ORDER BY start), 0) AS start, start AS stop FROM (
  SELECT user_id, start, stop FROM speech UNION ALL SELECT user_id, total, total FROM len) g),
both_ AS (SELECT 'speech' AS kind, user_id, start, stop FROM speech UNION ALL SELECT 'background', user_id, start, stop FROM gaps WHERE start < stop),
c AS (SELECT kind, user_id, CAST(floor((start + stop - {LEVEL}) / 2e0) AS bigint) AS first, row_number() OVER (PARTITION BY user_id, kind ORDER BY start) - 1 AS r, count(*) OVER (PARTITION BY user_id, kind) AS n
  FROM both_ WHERE stop - {LEVEL} >= start),
i AS (SELECT kind, user_id, n, {linspace} FROM (SELECT DISTINCT kind, user_id, n FROM c WHERE n > {LEVELS}) m),
w AS (SELECT kind, user_id, first FROM c WHERE n <= {LEVELS} UNION ALL SELECT c.kind, c.user_id, c.first FROM c JOIN (
  SELECT DISTINCT kind, user_id, CAST(floor(i * (n - 1) / {LEVELS - 1}e0) AS bigint) AS r FROM i) p ON c.kind = p.kind AND c.user_id = p.user_id AND c.r = p.r),
f AS (SELECT kind, user_id, first, {d.explode(d.range('0', str(LEVEL - 1)), 'j')} FROM w),
rms AS (SELECT f.kind, f.user_id, f.first, sqrt(avg(s.x * s.x)) AS level FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.first + f.j GROUP BY f.kind, f.user_id, f.first),
m AS (SELECT user_id, {d.median("CASE WHEN kind = 'speech' THEN level END")} AS a, {d.median("CASE WHEN kind <> 'speech' THEN level END")} AS b,
  {d.count_if("kind = 'speech'")} AS speech_windows, {d.count_if("kind <> 'speech'")} AS background_windows FROM rms GROUP BY user_id),
z AS (SELECT *, round(20 * log10(greatest(a, 1e-8) / greatest(b, 1e-8)), 3) AS snr FROM m)
SELECT len.user_id, coalesce(speech_windows, 0) AS speech_windows, coalesce(background_windows, 0) AS background_windows, snr,
  CASE WHEN snr IS NULL THEN 'unestimated' WHEN snr <= 20 THEN 'background-noisy' WHEN snr <= 30 THEN 'background-moderate' ELSE 'background-clean' END AS noise_condition
FROM len LEFT JOIN z ON len.user_id = z.user_id"""


add("speech_snr", snr)
