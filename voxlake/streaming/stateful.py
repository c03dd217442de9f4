"""Sessions over streams of frames: state kept per key, results marked provisional, retracted or final.

A step is a small function of one frame and the state before it. It runs in
`applyInPandasWithState` on a stream, and equals the fold of the same frames in
batch form (`voxlake/plans/folds.py`). Frames of a key are taken in the order of
`seq`, which is the stream's own time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

OUT = "key long, seq long, event string, since long"


@dataclass
class Endpointer:
    """Speech starts after two frames of 0.5 or more, goes on at 0.35 or more, and ends after eight lower ones.

    It is dropped if fewer than five frames were voiced.
    """

    frames: int = 0
    on: bool = False
    voiced: int = 0
    silent: int = 0
    began: int = 0

    def step(self, p: float) -> str | None:
        self.frames += 1
        if not self.on:
            self.silent = 0
            self.voiced = self.voiced + 1 if p >= 0.5 else 0
            if self.voiced < 2:
                return None
            self.on, self.began = True, self.frames
            return "start"
        if p >= 0.35:
            self.voiced, self.silent = self.voiced + 1, 0
            return None
        self.silent += 1
        if self.silent < 8:
            return None
        event = "end" if self.voiced >= 5 else "drop"
        self.on, self.voiced = False, 0
        return event

    def flush(self) -> str | None:
        return "disconnected" if self.on else None


@dataclass
class Provisional:
    """A turn's end is provisional after three low frames, retracted by a higher one, final after eight."""

    on: bool = False
    silent: int = 0
    began: int = 0

    def step(self, p: float) -> str | None:
        if not self.on:
            if p >= 0.5:
                self.on, self.silent, self.began = True, 0, self.began + 1
            return None
        if p >= 0.35:
            event, self.silent = ("retracted" if self.silent >= 3 else None), 0
            return event
        self.silent += 1
        if self.silent == 8:
            self.on, self.silent = False, 0
            return "final"
        return "provisional" if self.silent == 3 else None

    def flush(self) -> str | None:
        return "disconnected" if self.on else None


@dataclass
class Controller:
    """Ducks after three voiced frames, stops on content or twelve voiced ones, resumes after five quiet ones or twenty-five in all.

    A frame's value is its level; every ninth `seq` carries content.
    """

    mode: int = 0
    run: int = 0
    quiet: int = 0
    began: int = 0

    def step(self, p: float, content: bool = False) -> str | None:
        voiced, mode, event = p >= 0.4, self.mode, None
        if mode == 0 and voiced and self.run + 1 >= 3:
            self.mode, event = 1, "duck"
        elif mode == 1 and (content or self.run + 1 >= 12) and voiced:
            self.mode, event = 2, "stop"
        elif mode == 1 and ((not voiced and self.quiet + 1 >= 5) or self.began + 1 >= 25):
            self.mode, event = 0, "resume"
        elif mode == 2 and not voiced:
            self.mode = 0
        self.run, self.quiet = (self.run + 1, 0) if voiced else (0, self.quiet + 1)
        self.began = self.began + 1 if mode == 1 else 0
        return event

    def flush(self) -> str | None:
        return "disconnected" if self.mode else None


@dataclass
class Debouncer:
    """Fires at the third frame in a row of 0.5 or more."""

    run: int = 0
    began: int = 0

    def step(self, p: float) -> str | None:
        self.run = self.run + 1 if p >= 0.5 else 0
        return "fire" if self.run == 3 else None

    def flush(self) -> str | None:
        return None


@dataclass
class HoldBack:
    """Frames of a speculative run are held; three high frames confirm and count them, two low ones discard them."""

    held: int = 0
    high: int = 0
    low: int = 0
    began: int = 0

    def step(self, p: float) -> str | None:
        self.held += 1
        self.high, self.low = (self.high + 1, 0) if p >= 0.5 else (0, self.low + 1)
        if self.high == 3 or self.low == 2:
            event, self.began = ("released" if self.high == 3 else "discarded"), self.held
            self.held = self.high = self.low = 0
            return event
        return None

    def flush(self) -> str | None:
        return "discarded" if self.held else None


_KINDS = {int: "long", bool: "boolean"}


def sessions(frames: DataFrame, machine: Callable, timeout_ms: int | None = None, content: bool = False) -> DataFrame:
    """Events (key, seq, event, since) of the stream frames (key, seq, p, ts), by a state machine per key.

    Within a micro-batch frames are put in the order of seq; a frame older than
    the last one seen of its key is dropped, as the machine has moved on. Frames
    without key, seq or p are dropped. With timeout_ms, frames need a watermark on
    ts, and a key is flushed once that is so far past its last frame: an open
    session ends as `disconnected`. Without, sessions stay open.
    """
    fresh = asdict(machine())
    fields = {f: type(v) for f, v in fresh.items()}
    state_type = StructType.fromDDL("last long, " + ", ".join(f"{f} {_KINDS[t]}" for f, t in fields.items()))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *rest = state.get if state.exists else (-1, *fresh.values())
        own, seqs, events, since = machine(*rest), [], [], []
        if state.hasTimedOut:
            event = own.flush()
            state.remove()
            if event:
                yield pd.DataFrame([(key[0], last, event, own.began)], columns=["key", "seq", "event", "since"])
            return
        found = list(batches)  # a key has few rows in a batch, so what is done once per key counts
        rows = found[0] if len(found) == 1 else pd.concat(found)
        newest = int(rows["ts"].max().timestamp() * 1000) if timeout_ms else 0
        seq_, p_ = rows["seq"].to_numpy(), rows["p"].to_numpy()
        order = seq_.argsort(kind="stable")
        for seq, p in zip(seq_[order].tolist(), p_[order].tolist(), strict=True):
            if seq <= last:
                continue
            event, last = own.step(p, seq % 9 == 0) if content else own.step(p), seq
            if event:
                seqs.append(seq)
                events.append(event)
                since.append(own.began)
        state.update((last, *(getattr(own, f) for f in fields)))
        if timeout_ms:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + timeout_ms)
        if seqs:
            yield pd.DataFrame({"key": [key[0]] * len(seqs), "seq": seqs, "event": events, "since": since})

    columns = ["key", "seq", "p", "ts"] if timeout_ms else ["key", "seq", "p"]
    known = frames.where("key IS NOT NULL AND seq IS NOT NULL AND p IS NOT NULL").select(*columns)
    timeout = GroupStateTimeout.EventTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return known.groupBy("key").applyInPandasWithState(run, OUT, state_type, "append", timeout)


def latest_acks(acks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first ack of each (session, turn) of a stream (session, turn, ts, ...): repeats within the delay are dropped."""
    return acks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "turn"])


def counts(frames: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(hour, n, total) of a stream (ts, value): tumbling windows, final once the watermark has passed them."""
    from pyspark.sql import functions as F

    windowed = frames.withWatermark("ts", delay).groupBy(F.window("ts", width))
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "n", "total")
