"""Order-dependent selections: folds over the sorted rows of a group, which depend on what was kept before.

Spark folds an array per group with `aggregate`; the SQL of the oracle walks the same rows recursively.
"""

from __future__ import annotations

from .catalogue import BIN, binned, segments
from .sql import add


#: Rows of a chunk of a fold.
CHUNK = 64


def fold(d, ctes: str, items: str, group: str, order: str, columns: str, state: dict[str, tuple[str, str]], emit: dict[str, str]) -> str:
    """SQL of the rows (group, r, columns, emitted values) of a fold.

    items is a query; its rows are taken by group, in `order`, as x. state maps
    names to (first value, next value); emit maps names to values. Next values and emitted ones are
    expressions of the state before, a.name, and of the row, x.column.
    """
    cols = columns.split()
    ranked = f"SELECT {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS r, {', '.join(cols)} FROM ({items}) i0"
    if d.name == "duck":
        first = ", ".join(f"{v[0]} AS {k}" for k, v in state.items())
        after = ", ".join(f"{v[1]} AS {k}" for k, v in state.items())
        none = ", ".join(f"{_typed(v)} AS e_{k}" for k, v in emit.items())
        out = ", ".join(f"{v} AS e_{k}" for k, v in emit.items())
        head = "WITH RECURSIVE " + (ctes + ", " if ctes else "")
        named = ", ".join([f"x.{c}" for c in cols] + [f"a.e_{k} AS {k}" for k in emit])
        return f"""{head}it AS MATERIALIZED ({ranked}), walk AS (
  SELECT DISTINCT g, CAST(0 AS bigint) AS r, {first}, {none} FROM it
  UNION ALL SELECT x.g, x.r, {after}, {out} FROM walk a JOIN it x ON x.g = a.g AND x.r = a.r + 1),
folded AS (SELECT x.g, x.r, {named} FROM walk a JOIN it x ON x.g = a.g AND x.r = a.r)"""
    pack = ", ".join(["r", *cols])
    first = ", ".join(f"'{k}', {v[0]}" for k, v in state.items())
    after = ", ".join(f"'{k}', {v[1]}" for k, v in state.items())
    same = lambda x: ", ".join(f"'{k}', {x}.{k}" for k in state)
    out = ", ".join(f"'{k}', {v}" for k, v in emit.items())
    body = ", ".join(f"'{c}', x.{c}" for c in ("r", *cols))
    sample = ", ".join([f"'{c}', i[0].{c}" for c in ("r", *cols)] + [f"'{k}', {_typed(v)}" for k, v in emit.items()])
    head = f"WITH {ctes}, " if ctes else "WITH "
    none = f"slice(array(named_struct({sample})), 1, 0)"
    # what is emitted gathers in chunks of {CHUNK} rows, as an array is copied for each element that is added to it
    step = f"(a, x) -> named_struct({after}, 'out', concat(a.out, array(named_struct({body}, {out}))), 'outs', a.outs)"
    chunk = f"aggregate(c, named_struct({same('s')}, 'out', {none}, 'outs', s.outs), {step}, b -> named_struct({same('b')}, 'outs', concat(b.outs, array(b.out))))"
    chunks = f"transform(sequence(0, CAST((size(i) - 1) DIV {CHUNK} AS int)), k -> slice(i, k * {CHUNK} + 1, {CHUNK}))"
    return f"""{head}it AS ({ranked}), packed AS (SELECT g, array_sort(collect_list(struct({pack}))) AS i FROM it GROUP BY g),
folded AS (SELECT g, o.* FROM (SELECT g, explode(aggregate({chunks}, named_struct({first}, 'outs', slice(array({none}), 1, 0)),
  (s, c) -> {chunk}, s -> flatten(s.outs))) AS o FROM packed) e)"""


def _typed(expression: str) -> str:
    """A value of the type that an emitted expression has, by its cast."""
    kind = expression.rpartition(" AS ")[2].rstrip(")").strip() if expression.startswith("CAST(") else "boolean"
    return f"CAST(NULL AS {kind})"


def keep(condition: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


# ---- pairs of turns ------------------------------------------------------------------------------

CANDIDATES = """n AS (SELECT conv_id, turn, speaker, start, stop, row_number() OVER w - 1 AS i, lead(speaker) OVER w AS other, lead(start) OVER w AS other_start, lead(stop) OVER w AS other_stop
  FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start, stop, turn)),
c AS (SELECT conv_id, turn, i, start AS user_start, other_stop, least(start, other_start) AS span_start, greatest(stop, other_stop) AS span_stop,
             least(stop, other_stop) - greatest(start, other_start) AS overlap
      FROM n WHERE other <> speaker AND other_start - stop <= 2.5e0 AND stop - start >= 0.25e0 AND other_stop - other_start >= 0.25e0)"""

STRIDE = "x.span_start >= a.until"
add("pair_stride_greedy", lambda d: fold(
    d, f"{segments(d)}, {CANDIDATES}", "SELECT * FROM c WHERE i % 2 = 0", "conv_id", "i", "turn span_start span_stop",
    {"until": ("-1e0", keep(STRIDE, "x.span_stop", "a.until"))}, {"kept": STRIDE}) + "\nSELECT g AS conv_id, turn, round(span_stop - span_start, 6) AS seconds FROM folded WHERE kept")

add("qa_candidates", lambda d: fold(
    d, f"{segments(d)}, {CANDIDATES}", "SELECT * FROM c WHERE i % 2 = 0", "conv_id", "i", "turn span_start span_stop overlap",
    {"until": ("-1e0", keep(STRIDE, "x.span_stop", "a.until"))}, {"kept": f"{STRIDE} AND x.overlap >= 0.2e0"}) + "\nSELECT g AS conv_id, turn, round(overlap, 6) AS overlap FROM folded WHERE kept")


def max_duration(d) -> str:
    """Non-overlapping pairs of the greatest total duration, then number: dynamic programming by end, then a walk back."""
    put = (lambda x, y: f"concat({x}, array({y}))") if d.name == "spark" else (lambda x, y: f"list_append({x}, {y})")
    before = lambda x: d.at(x, "x.before + 1")
    last = lambda x: d.at(x, "x.place")
    total, number = f"({before('a.total')} + x.seconds)", f"({before('a.number')} + 1)"
    take = f"({total} > {last('a.total')} OR ({total} = {last('a.total')} AND {number} > {last('a.number')}))"
    numbered = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY span_stop, span_start, user_start, other_stop, turn) AS place FROM c"
    ctes = f"""{segments(d)}, {CANDIDATES}, o AS ({numbered}), b AS (
  SELECT conv_id, place, before FROM (
    SELECT conv_id, place, sum(CASE WHEN place IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS before FROM (
      SELECT conv_id, CAST(NULL AS bigint) AS place, span_stop AS t FROM o UNION ALL SELECT conv_id, place, span_start FROM o) u) v WHERE place IS NOT NULL),
ready AS (SELECT o.*, b.before, span_stop - span_start AS seconds FROM o JOIN b ON o.conv_id = b.conv_id AND o.place = b.place)"""
    first = fold(d, ctes, "SELECT * FROM ready", "conv_id", "place", "turn place before seconds",
                 {"total": (d.array("0e0"), put("a.total", keep(take, total, last("a.total")))),
                  "number": (d.array("CAST(0 AS bigint)"), put("a.number", keep(take, number, last("a.number"))))}, {"take": take})
    items = "SELECT g AS conv_id, turn, place, before, seconds, take, max(place) OVER (PARTITION BY g) AS n FROM folded"
    here = "x.place = CASE WHEN a.at < 0 THEN x.n ELSE a.at END"
    back = fold(d, "", "SELECT * FROM back", "conv_id", "place DESC", "turn place before seconds take n",
                {"at": ("CAST(-1 AS bigint)", keep(here, "CASE WHEN x.take THEN x.before ELSE x.place - 1 END", "a.at"))}, {"kept": f"{here} AND x.take"})
    back = back.split("WITH RECURSIVE " if d.name == "duck" else "WITH ", 1)[1]
    for a, z in (("it AS", "it2 AS"), ("FROM it ", "FROM it2 "), ("FROM it\n", "FROM it2\n"), ("JOIN it ", "JOIN it2 "), ("walk", "walk2"), ("packed", "packed2"), ("folded AS", "folded2 AS")):
        back = back.replace(a, z)
    return f"{first}, back AS ({items}), {back}\nSELECT g AS conv_id, turn, round(seconds, 6) AS seconds FROM folded2 WHERE kept"


add("pair_max_duration", max_duration)

NEAR = "x.onset - a.onset >= 3 AND CASE x.kind WHEN 'overlap_onset' THEN a.k1 WHEN 'short_response' THEN a.k2 ELSE a.k3 END < 4"
add("event_mining", lambda d: fold(
    d, f"""{segments(d)}, pr AS (SELECT a.conv_id, a.turn, a.speaker, a.start, a.stop, b.start AS prior_start, b.stop AS prior_stop,
  row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.stop DESC, b.start, b.turn) AS r
  FROM {binned(d, 'seg', 'start - 2', 'start')} a JOIN {binned(d, 'seg')} b ON a.conv_id = b.conv_id{'' if d.name == 'duck' else f" AND a.bin = b.bin AND a.bin = CAST(floor(greatest(a.start - 2, b.start) / {BIN}) AS bigint)"} AND b.speaker <> a.speaker AND b.stop > a.start - 2 AND (b.start, b.stop, b.turn) < (a.start, a.stop, a.turn)),
ev AS (SELECT conv_id, turn, start AS onset, CASE WHEN prior_stop > start + 0.15e0 THEN CASE WHEN stop - start <= 1.5e0 THEN 'short_response' ELSE 'overlap_onset' END
         ELSE CASE WHEN stop - start <= 1.5e0 THEN 'short_response' ELSE 'turn_change' END END AS kind
  FROM pr WHERE r = 1 AND start >= 2 AND least(prior_stop, start) - greatest(prior_start, start - 2) >= 0.5e0 AND (prior_stop > start + 0.15e0 OR start - prior_stop BETWEEN 0 AND 1))""",
    "SELECT * FROM ev", "conv_id", "onset, turn", "turn onset kind",
    {"onset": ("-1e9", keep(NEAR, "x.onset", "a.onset")),
     **{f"k{i}": ("CAST(0 AS bigint)", keep(f"{NEAR} AND x.kind = '{k}'", f"a.k{i} + 1", f"a.k{i}")) for i, k in ((1, "overlap_onset"), (2, "short_response"), (3, "turn_change"))}},
    {"kept": NEAR}) + "\nSELECT g AS conv_id, turn, kind, round(onset, 3) AS onset FROM folded WHERE kept")

# ---- packing -------------------------------------------------------------------------------------

GAP = "CASE WHEN a.source_stop < -5e8 THEN 0e0 ELSE least(2e0, greatest(0e0, x.start - a.source_stop)) END"
OVER = f"a.cursor_ > 0 AND a.cursor_ + {GAP} + (x.stop - x.start) > 60"
add("window_packing", lambda d: fold(
    d, f"{segments(d)}", "SELECT * FROM seg WHERE stop > start", "conv_id", "start, stop, turn", "turn start stop",
    {"cursor_": ("0e0", f"CASE WHEN {OVER} THEN x.stop - x.start ELSE a.cursor_ + {GAP} + (x.stop - x.start) END"),
     "source_stop": ("-1e9", "x.stop"), "bin": ("CAST(0 AS bigint)", keep(OVER, "a.bin + 1", "a.bin"))},
    {"bin": f"CAST({keep(OVER, 'a.bin + 1', 'a.bin')} AS bigint)", "placed": f"CAST({keep(OVER, '0e0', f'a.cursor_ + {GAP}')} AS double)"}) +
    "\nSELECT g AS conv_id, turn, bin, round(placed, 6) AS placed FROM folded")

ADAPT = "CASE WHEN x.level < a.floor_ THEN 0.5e0 * a.floor_ + 0.5e0 * x.level ELSE 0.95e0 * a.floor_ + 0.05e0 * x.level END"
add("adaptive_floor", lambda d: fold(
    d, "", "SELECT user_id, event_id, value AS level FROM events", "user_id", "event_id", "event_id level",
    {"floor_": ("50e0", ADAPT)}, {"probability": f"CAST(1 / (1 + exp(-(x.level - ({ADAPT}) - 6) / 3)) AS double)"}) +
    "\nSELECT event_id, round(probability, 6) AS probability FROM folded")

# ---- streams in batch form: one row per frame, by session -----------------------------------------

#: Two frames of 0.5 or more start speech, which goes on at 0.35 or more; eight frames below end it; five voiced frames are the least.
START = "NOT a.on AND x.p >= 0.5e0 AND a.voiced + 1 >= 2"
END = "a.on AND x.p < 0.35e0 AND a.silent + 1 >= 8"
FRAMES = "SELECT user_id, event_id, value / 100e0 AS p FROM events"
add("session_hysteresis", lambda d: fold(
    d, "", FRAMES, "user_id", "event_id", "event_id p",
    {"on": ("false", f"(a.on AND NOT ({END})) OR ({START})"),
     "voiced": ("CAST(0 AS bigint)", f"CASE WHEN a.on THEN CASE WHEN {END} THEN 0 WHEN x.p >= 0.35e0 THEN a.voiced + 1 ELSE a.voiced END WHEN x.p >= 0.5e0 THEN a.voiced + 1 ELSE 0 END"),
     "silent": ("CAST(0 AS bigint)", "CASE WHEN a.on AND x.p < 0.35e0 THEN a.silent + 1 ELSE 0 END"),
     "began": ("CAST(0 AS bigint)", keep(START, "x.r", "a.began"))},
    {"event": f"CAST(CASE WHEN {START} THEN 'start' WHEN {END} THEN CASE WHEN a.voiced >= 5 THEN 'end' ELSE 'drop' END END AS string)",
     "since": "CAST(a.began AS bigint)"}) +
    "\nSELECT g AS user_id, event_id, event, CAST(CASE WHEN event = 'start' THEN r ELSE since END AS bigint) AS began FROM folded WHERE event IS NOT NULL")

PAUSE, RESUME, FINAL = "a.on AND x.p < 0.35e0 AND a.silent + 1 = 3", "a.on AND x.p >= 0.35e0 AND a.silent >= 3", "a.on AND x.p < 0.35e0 AND a.silent + 1 >= 8"
add("provisional_events", lambda d: fold(
    d, "", FRAMES, "user_id", "event_id", "event_id p",
    {"on": ("false", f"(a.on OR x.p >= 0.5e0) AND NOT ({FINAL})"), "silent": ("CAST(0 AS bigint)", f"CASE WHEN a.on AND x.p < 0.35e0 AND NOT ({FINAL}) THEN a.silent + 1 ELSE 0 END"),
     "turn": ("CAST(0 AS bigint)", keep("NOT a.on AND x.p >= 0.5e0", "a.turn + 1", "a.turn"))},
    {"event": f"CAST(CASE WHEN {PAUSE} THEN 'provisional' WHEN {RESUME} THEN 'retracted' WHEN {FINAL} THEN 'final' END AS string)", "number": "CAST(a.turn AS bigint)"}) +
    "\nSELECT g AS user_id, event_id, number AS turn, event FROM folded WHERE event IS NOT NULL")

HOLD = "CASE WHEN a.asked THEN 20 ELSE 8 END"
ENDED = f"a.on AND x.p < 0.35e0 AND a.silent + 1 >= {HOLD}"
add("dynamic_hold", lambda d: fold(
    d, "", "SELECT user_id, event_id, value / 100e0 AS p, event_id % 5 = 0 AS unfinished FROM events", "user_id", "event_id", "event_id p unfinished",
    {"on": ("false", f"(a.on OR x.p >= 0.5e0) AND NOT ({ENDED})"), "silent": ("CAST(0 AS bigint)", f"CASE WHEN a.on AND x.p < 0.35e0 AND NOT ({ENDED}) THEN a.silent + 1 ELSE 0 END"),
     "asked": ("false", "CASE WHEN a.on AND x.p < 0.35e0 AND a.silent + 1 = 3 THEN x.unfinished WHEN a.on AND x.p < 0.35e0 THEN a.asked ELSE false END")},
    {"ended": ENDED, "held": "CAST(a.asked AS boolean)"}) + "\nSELECT g AS user_id, event_id, held FROM folded WHERE ended")

add("double_talk", lambda d: fold(
    d, "", """SELECT user_id, event_id, value AS mic, max(value * 0.6e0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS reference,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events""", "user_id", "event_id", "event_id mic reference n",
    {"coupling": ("1e0", keep("x.reference > 0 AND x.mic < a.coupling * x.reference * 1.5e0", "0.9e0 * a.coupling + 0.1e0 * x.mic / x.reference", "a.coupling")),
     "floor_": ("30e0", "CASE WHEN x.n <= 16 THEN 0.8e0 * a.floor_ + 0.2e0 * x.mic ELSE 0.95e0 * a.floor_ + 0.05e0 * least(x.mic, 2 * a.floor_) END")},
    {"talks": "x.mic > a.coupling * x.reference + 6 AND x.mic > a.floor_ + 6"}) + "\nSELECT event_id, talks FROM folded")

DUCK = "a.mode = 0 AND x.voiced AND a.run + 1 >= 3"
STOP = "a.mode = 1 AND (x.content OR a.run + 1 >= 12) AND x.voiced"
BACK = "a.mode = 1 AND ((NOT x.voiced AND a.quiet + 1 >= 5) OR a.since + 1 >= 25)"
add("duck_stop_resume", lambda d: fold(
    d, "", "SELECT user_id, event_id, value >= 40 AS voiced, event_id % 9 = 0 AS content FROM events", "user_id", "event_id", "event_id voiced content",
    {"mode": ("CAST(0 AS bigint)", f"CASE WHEN {DUCK} THEN 1 WHEN {STOP} THEN 2 WHEN {BACK} THEN 0 WHEN a.mode = 2 AND NOT x.voiced THEN 0 ELSE a.mode END"),
     "run": ("CAST(0 AS bigint)", keep("x.voiced", "a.run + 1", "0")), "quiet": ("CAST(0 AS bigint)", keep("x.voiced", "0", "a.quiet + 1")),
     "since": ("CAST(0 AS bigint)", keep("a.mode = 1", "a.since + 1", "0"))},
    {"event": f"CAST(CASE WHEN {DUCK} THEN 'duck' WHEN {STOP} THEN 'stop' WHEN {BACK} THEN 'resume' END AS string)"}) +
    "\nSELECT g AS user_id, event_id, event FROM folded WHERE event IS NOT NULL")

# ---- a row per size bucket, of a source that was not chosen before where there is one --------------


def unseen(d) -> str:
    novel = d.filter("x.cands", "NOT array_contains(a.used, split_part(w, '|', 2))")
    pick = f"coalesce({d.at(novel, '1')}, {d.at('x.cands', '1')})"
    source = f"split_part({pick}, '|', 2)"
    none, add_ = ("CAST(array() AS array<string>)", f"concat(a.used, array({source}))") if d.name == "spark" else ("CAST([] AS VARCHAR[])", f"list_append(a.used, {source})")
    key = d.sha("cast(doc_id AS string)")
    items = f"""SELECT lang, bucket, {d.gathered("concat(h, '|', source, '|', cast(doc_id AS string))", "h")} AS cands FROM (
      SELECT lang, source, doc_id, {key} AS h, ntile(8) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS bucket FROM documents) b GROUP BY lang, bucket"""
    return fold(d, "", items, "lang", "bucket", "bucket cands", {"used": (none, add_)}, {"pick": f"CAST({pick} AS string)"}) + \
        "\nSELECT g AS lang, CAST(bucket AS bigint) AS bucket, split_part(pick, '|', 2) AS source, CAST(split_part(pick, '|', 3) AS bigint) AS doc_id FROM folded"


add("quantile_unseen", unseen)

# ---- turns in windows that drift -------------------------------------------------------------------

#: Seconds that a clock may move away from its first offset.
DRIFT = 120


def drifting(d) -> str:
    """Planned turns with the number of heard ends in their windows, shifted by an offset that follows the clock.

    The first offset is the median distance of a session's first eight heard ends to the nearest of its first twelve planned ones.
    """
    near = lambda own: (f"array_min(transform({own}, w -> struct(abs(w - x.stop - ({SHIFT})) AS k, w AS v))).v" if d.name == "spark" else f"list_sort(list_transform({own}, lambda w: {{'k': abs(w - x.stop - ({SHIFT})), 'v': w}}))[1].v")
    own = d.filter("x.heard", f"w >= x.start + ({SHIFT}) - 1.5e0 AND w < x.high + ({SHIFT}) - 1.5e0")
    moved = f"CASE WHEN {d.size(own)} = 0 THEN {SHIFT} ELSE 0.7e0 * ({SHIFT}) + 0.3e0 * ({near(own)} - x.stop) END"
    return fold(
        d, f"""raw AS (SELECT conv_id, turn, turn * 13e0 AS start, turn * 13e0 + 4 AS stop, turn * 13.02e0 + 4.5e0 + length(text) % 3 + conv_id % 5 AS ends FROM conversations),
plan AS (SELECT conv_id, turn, start, stop, coalesce(lead(start) OVER w, 1e12) AS high, row_number() OVER w AS nth FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY start, turn)),
early AS (SELECT conv_id, turn, ends FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ends, turn) AS nth FROM raw) e WHERE nth <= 8),
gap AS (SELECT e.conv_id, e.turn, e.ends - p.stop AS gap, row_number() OVER (PARTITION BY e.conv_id, e.turn ORDER BY abs(e.ends - p.stop), p.nth) AS r FROM early e JOIN plan p ON p.conv_id = e.conv_id AND p.nth <= 12),
initial AS (SELECT conv_id, {d.median('gap')} AS initial FROM gap WHERE r = 1 GROUP BY conv_id),
ready AS (SELECT p.conv_id, p.turn, p.start, p.stop, p.high, i.initial FROM plan p JOIN initial i ON i.conv_id = p.conv_id),
heard AS (SELECT p.conv_id, p.turn, p.start, p.stop, p.high, p.initial, {d.gathered('r.ends', 'r.ends')} AS heard FROM {binned(d, 'ready', f'start + initial - {DRIFT}', f'least(high, start + {DRIFT}) + initial + {DRIFT}')} p
  JOIN {binned(d, 'raw', 'ends', 'ends')} r ON r.conv_id = p.conv_id{'' if d.name == 'duck' else ' AND r.bin = p.bin'} AND r.ends BETWEEN p.start + p.initial - {DRIFT} AND least(p.high, p.start + {DRIFT}) + p.initial + {DRIFT}
  GROUP BY p.conv_id, p.turn, p.start, p.stop, p.high, p.initial),
lined AS (SELECT p.*, coalesce(h.heard, {"CAST(array() AS array<double>)" if d.name == "spark" else "CAST([] AS DOUBLE[])"}) AS heard FROM ready p LEFT JOIN heard h ON h.conv_id = p.conv_id AND h.turn = p.turn)""",
        "SELECT * FROM lined", "conv_id", "start, turn", "turn start stop high initial heard",
        {"shift": ("CAST(NULL AS double)", moved)},
        {"heard_turns": f"CAST({d.size(own)} AS bigint)", "shift_": f"CAST({moved} AS double)"}) + \
        "\nSELECT g AS conv_id, turn, heard_turns AS turns, round(shift_, 3) AS shift FROM folded"


SHIFT = "coalesce(a.shift, x.initial)"
add("drifting_turns", drifting)
