"""Processors with state of several kinds: turns with holds and held results, clauses that are carried on, trailing ranges.

Each processor is keyed by session and keeps values, lists and timers in the state store. Rows of a micro-batch
are put in the order of event time and `seq`; rows that are older than the last one
of their session are dropped, as the session has moved on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors with lists and timers need.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    spark.conf.set(STORE, ROCKS)


def _millis(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64") // 1000).tolist()


def _gathered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The frames of a session as one; mostly it is one."""
    found = list(rows)
    return found[0] if len(found) == 1 else pd.concat(found)


# ---- turns: dynamic holds, results held back, open sessions that end by timer -----------------------


@dataclass
class Limits:
    """Frames: voiced ones that start speech, of a turn at least, silent ones to a pause, to the end, to the end when held."""

    onset: int = 2
    least: int = 2
    pause: int = 1
    end: int = 3
    held: int = 5


@dataclass
class Turn:
    """A session's open turn, in frames. gate: the last turn is confirmed and no new one has begun."""

    frames: int = 0
    on: bool = False
    voiced: int = 0
    silent: int = 0
    began: int = 0
    heard: int = 0
    paused: bool = False
    hold: int = 0
    gate: bool = False

    def frame(self, p: float, limits: Limits) -> str | None:
        """The decision that a frame's speech probability completes."""
        self.frames += 1
        if not self.on:
            self.voiced = self.voiced + 1 if p >= 0.5 else 0
            if self.voiced < limits.onset:
                return None
            self.on, self.gate, self.silent = True, False, 0
            self.began, self.heard = self.frames - limits.onset + 1, self.frames
            return "speech_start"
        if p >= 0.35:
            resumed, self.paused = self.paused, False
            self.heard, self.silent, self.hold = self.frames, 0, 0
            return "speech_resume" if resumed else None
        self.silent += 1
        long = self.heard - self.began + 1 >= limits.least
        if long and not self.paused and limits.pause <= self.silent < limits.end:
            self.paused = True
            return "speech_pause"
        if self.silent < max(limits.end, self.hold):
            return None
        self.on, self.paused, self.voiced, self.hold, self.gate = False, False, 0, 0, long
        return "speech_end" if long else "drop"

    def verdict(self, unfinished: bool, limits: Limits) -> str:
        """What a classifier's verdict on the open pause does; without one it comes too late."""
        if not self.paused:
            return "late"
        if unfinished:
            self.hold = limits.held
        return "held" if unfinished else "complete"


class Turns(StatefulProcessor):
    """Value state: the turn. List state: results held back. Timer: a session without rows for `timeout_ms` ends."""

    TURN = "last_ms long, last_seq long, frames long, `on` boolean, voiced long, silent long, began long, heard long, paused boolean, hold long, gate boolean"

    def __init__(self, limits: Limits, timeout_ms: int):
        self.limits, self.timeout_ms = limits, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", self.TURN)
        self.held = handle.getListState("held", "seq long")

    def _load(self) -> tuple[int | None, int, Turn, list[int]]:
        found = self.turn.get()  # each call of the state store is a round trip, so none is made in vain
        if found is None:
            return None, -1, Turn(), []
        ms, seq, *rest = found
        turn = Turn(*rest)
        return ms, seq, turn, [x[0] for x in self.held.get()] if turn.paused and self.held.exists() else []  # results are held in a pause only

    @staticmethod
    def _ended(seq: int, turn: Turn, held: list[int]) -> list[tuple]:
        """What is left of a session that nobody closed."""
        out = [(s, "discarded", seq, i + 1) for i, s in enumerate(held)]
        return [*out, (seq, "disconnected", seq, 0)] if turn.on else out

    def _row(self, turn: Turn, held: list[int], seq: int, kind: str, p: float, unfinished: bool) -> list[tuple]:
        if kind == "verdict":
            return [(seq, turn.verdict(unfinished, self.limits), seq, 0)]
        if kind == "result":
            if turn.paused:
                held.append(seq)
                return []
            return [(seq, "sent" if turn.gate else "discarded", seq, 0)]
        event = turn.frame(p, self.limits)
        out = [(seq, event, seq, 0)] if event else []
        if event in ("speech_end", "speech_resume"):  # in order on confirmation, thrown away if the speaker goes on
            fate = "released" if event == "speech_end" else "discarded"
            out += [(s, fate, seq, i + 1) for i, s in enumerate(held)]
            held.clear()
        return out

    def _frame(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "seq", "event", "decided", "place"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, last_seq, turn, held = self._load()
        before, had, out = last, len(held), []
        batch = _gathered(rows).sort_values(["ts", "seq"])
        columns = (batch[c].tolist() for c in ("seq", "kind", "p", "unfinished"))
        for ms, seq, kind, p, unfinished in zip(_millis(batch["ts"]), *columns, strict=True):
            if last is not None and (ms, seq) <= (last, last_seq):
                continue
            if last is not None and ms > last + self.timeout_ms:  # the timer would have come first
                out += self._ended(last_seq, turn, held)
                turn, held = Turn(), []
            last, last_seq = ms, seq
            out += self._row(turn, held, seq, kind, p, bool(unfinished))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.timeout_ms)
            self.handle.registerTimer(last + self.timeout_ms)
        self.turn.update((last, last_seq, *astuple(turn)))
        if held:
            self.held.put([(s,) for s in held])
        elif had:
            self.held.clear()
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, seq, turn, held = self._load()
        self.turn.clear()
        self.held.clear()
        yield from self._frame(key, self._ended(seq, turn, held))

    def close(self) -> None:
        pass


def turns(rows: DataFrame, limits: Limits | None = None, timeout_ms: int = 3_600_000) -> DataFrame:
    """Events (key, seq, event, decided, place) of a watermarked stream (key, seq, ts, kind, p, unfinished).

    kind is `frame` (with p), `verdict` (with unfinished) or `result`. Frames give speech_start, speech_pause,
    speech_resume, speech_end or drop. Verdicts are held, complete or late. Results that come in a pause are
    held back: released in order (place, at the frame `decided`) once the turn ends, discarded if the speaker goes
    on; others are sent, or discarded when no turn is confirmed. Sessions without rows for timeout_ms are over:
    an open turn ends as disconnected, by a timer on event time or when the next row shows the gap.
    Rows without key, seq or ts are dropped, and so are frames without p.
    """
    with_store(rows.sparkSession)
    known = rows.where("key IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL AND (kind <> 'frame' OR p IS NOT NULL)")
    processor = Turns(limits or Limits(), timeout_ms)
    return known.groupBy("key").transformWithStateInPandas(processor, "key long, seq long, event string, decided long, place long", "Append", "EventTime")


# ---- clauses ----------------------------------------------------------------------------------------

#: Marks that end a clause.
CLAUSE_MARKS = ".!?؟،؛:\n"
_UNIT = re.compile(rf"[^\s{re.escape(CLAUSE_MARKS)}]*[\s{re.escape(CLAUSE_MARKS)}]")


@dataclass
class Clause:
    """The unfinished clause: its text, the words in it, whether the last one is open, and clauses before it."""

    text: str = ""
    words: int = 0
    inside: bool = False
    given: int = 0
    #: Characters of `text` that were looked at.
    done: int = 0

    def push(self, delta: str, first: tuple[int, int], later: int) -> list[str]:
        """Clauses that `delta` completes: at a mark after enough words, or at white space after the most words."""
        out, rest, at, cut = [], self.text + delta, self.done, 0
        for m in _UNIT.finditer(rest, self.done):
            body, mark = m.group()[:-1], m.group()[-1]
            at = m.end()
            if (body or not mark.isspace()) and not self.inside:
                self.words, self.inside = self.words + 1, True
            least, most = first if self.given == 0 else (1, later)
            if (mark in CLAUSE_MARKS and self.words >= least) or (mark.isspace() and self.words >= most):
                out.append(rest[cut:at].strip())
                cut, self.words, self.inside, self.given = at, 0, False, self.given + 1
            elif mark.isspace():
                self.inside = False
        self.text, self.done = rest[cut:], at - cut
        return out

    def flush(self) -> list[str]:
        rest, self.text = self.text.strip(), ""
        return [rest] if rest else []


class Clauses(StatefulProcessor):
    """Value state: the unfinished clause of a reply, which goes with the reply's last delta or by timer."""

    def __init__(self, first: tuple[int, int], later: int, timeout_ms: int):
        self.first, self.later, self.timeout_ms = first, later, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clause = handle.getValueState("clause", "text string, words long, inside boolean, given long, done long, next long, timer long")

    def _out(self, key: tuple, place: int, found: list[str]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(*key, place + i + 1, c) for i, c in enumerate(found)], columns=["key", "reply", "place", "clause"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, following, timer = Clause(), 0, 0
        kept = self.clause.get()
        if kept is not None:
            *fields, following, timer = kept
            own = Clause(*fields)
        place, found, over = own.given, [], False
        batch = _gathered(rows).sort_values("seq")
        for seq, delta, last in zip(batch["seq"].tolist(), batch["delta"].tolist(), batch["last"].tolist(), strict=True):
            if seq < following:
                continue
            found += own.push(delta or "", self.first, self.later)
            following = seq + 1
            if last:
                found += own.flush()
                over = True
        if timer:
            self.handle.deleteTimer(timer)
        if over and kept is not None:
            self.clause.clear()
        elif not over:
            timer = max(max(_millis(batch["ts"])), timerValues.getCurrentWatermarkInMs()) + self.timeout_ms
            self.handle.registerTimer(timer)
            self.clause.update((*astuple(own), following, timer))
        yield from self._out(key, place, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fields = self.clause.get()
        self.clause.clear()
        yield from self._out(key, fields[3], Clause(*fields[:4]).flush())

    def close(self) -> None:
        pass


def clauses(deltas: DataFrame, first: tuple[int, int] = (3, 7), later: int = 14, timeout_ms: int = 3_600_000) -> DataFrame:
    """Clauses (key, reply, place, clause) of a watermarked stream (key, reply, seq, delta, last, ts).

    A clause ends at the first mark with enough words before it (the first clause of a reply: first[0], later
    ones: 1), or at white space once it has the most words (first[1], later). How a reply is dealt into deltas doesn't matter.
    Between micro-batches only the unfinished clause is kept; a reply whose last delta never comes is flushed by timer.
    """
    if not 1 <= first[0] <= first[1] <= later:
        raise ValueError("limits of words must be in order")
    with_store(deltas.sparkSession)
    known = deltas.where("key IS NOT NULL AND reply IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL")
    out = "key long, reply long, place long, clause string"
    return known.groupBy("key", "reply").transformWithStateInPandas(Clauses(first, later, timeout_ms), out, "Append", "EventTime")


# ---- retention ----------------------------------------------------------------------------------------


class Trailing(StatefulProcessor):
    """List state: a session's values within the range before its newest row; older ones go, and the rest by timer."""

    def __init__(self, range_us: int):
        self.range_us = range_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us long, value double")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer = self.timer.get()  # set and cleared with the list
        kept = [] if timer is None else [tuple(x) for x in self.kept.get()]
        batch = _gathered(rows).sort_values(["ts", "seq"])
        us = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
        fresh = list(zip(us, batch["value"].tolist(), strict=True))
        every, out, low, high = sorted(kept + fresh), [], 0, 0
        for at, seq in zip(us, batch["seq"].tolist(), strict=True):
            while every[low][0] < at - self.range_us:
                low += 1
            while high < len(every) and every[high][0] <= at:
                high += 1
            own = [v for _, v in every[low:high]]
            out.append((key[0], seq, len(own), max(own), sum(own)))
        self.kept.put([x for x in every if x[0] >= us[-1] - self.range_us])
        if timer is not None:
            self.handle.deleteTimer(timer[0])
        ms = (us[-1] + self.range_us) // 1000 + 1
        self.handle.registerTimer(ms)
        self.timer.update((ms,))
        yield pd.DataFrame(out, columns=["key", "seq", "n", "greatest", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.timer.clear()
        yield from ()

    def close(self) -> None:
        pass


def trailing(rows: DataFrame, range_us: int) -> DataFrame:
    """(key, seq, n, greatest, total) over each row's own session and the range up to it, of a watermarked stream (key, seq, ts, value).

    A session's state is what lies within the range of its newest row, and goes when the watermark is beyond that.
    Micro-batches must come in the order of ts; rows without key, seq, ts or value are dropped.
    """
    with_store(rows.sparkSession)
    known = rows.where("key IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    out = "key long, seq long, n long, greatest double, total double"
    return known.groupBy("key").transformWithStateInPandas(Trailing(range_us), out, "Append", "EventTime")
