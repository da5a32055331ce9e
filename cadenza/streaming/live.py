"""Live detection and scoring requests on keyed state with values, lists and timers (``transformWithState``).

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    live(chunks).writeStream.option("checkpointLocation", ...).start()

A session's audio is a list of chunks and its histories a list of points, to which a batch appends what is new; flags are a value. So a batch
writes what it brings, not the session's state anew, but where the oldest chunks or points fall out of the window. Where chunks tell when they were sent, a timer
in that time ends a session that sends nothing for ``IDLE_MS``. (Times to live go by the clock; a query that has them runs batches for ever, so there are none.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from cadenza.streaming.detector import EVENTS, IDLE_MS, MAX_SECONDS, Policy, Session, as_mono, heuristic

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEADLINE_MS, GATE = 1000, 0.2
REPLIES = "session string, request_id long, p_eot double, status string"


def stateful(spark: SparkSession) -> None:
    """Keep state in RocksDB, which lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Detector(StatefulProcessor):
    """A session's chunks (t, sr, samples) to events; null samples begin it anew."""

    def __init__(self, policy: Policy, predict, at: str | None, idle_ms: int):
        self.policy, self.predict, self.at, self.idle_ms = policy, predict, at, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", "sr int, has_speech boolean, last_t double, held long, points int")
        self.audio = handle.getListState("audio", "samples binary")
        self.history = handle.getListState("history", "t double, p double, rms double")

    def known(self) -> tuple[Session, int, int]:
        """The session, and how many samples and points its lists hold."""
        got = self.flags.get()
        if got is None:
            return Session(), 0, 0
        sr, has_speech, last_t, held, points = got
        audio = b"".join(bytes(x[0]) for x in self.audio.get()) if held else b""
        history = np.array([tuple(x) for x in self.history.get()], np.float64).reshape(-1, 3) if points else np.zeros((0, 3))
        s = Session(audio, sr, has_speech, last_t, history.tobytes())
        s.buffer = s.buffer[-int(MAX_SECONDS * sr) :]
        return s, held, points

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, held, points = self.known()
        out, new_audio, new_points, cleared = [], [], [], False
        told = pd.concat(list(rows)).sort_values("t", kind="stable")
        for r in told.itertuples():
            if r.t <= s.last_t:
                continue
            if r.samples is None:
                s, cleared, new_audio, new_points = Session(last_t=r.t), True, [], []
                continue
            x = as_mono(r.samples)
            out.append((key[0], r.t, *s.step(r.t, r.sr, x, self.policy, self.predict)))
            new_audio = [s.buffer] if len(s.buffer) < len(x) else [*new_audio, s.buffer[len(s.buffer) - len(x) :]]
            cleared = cleared or not len(s.buffer)
            if not len(s.buffer):
                new_audio = []
            new_points.append(tuple(map(float, s.history[-1])))
        self.keep(s, held, points, new_audio, new_points, cleared)
        if self.at is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(int(told[self.at].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=["session", "t", "silence", "p_eot", "status"])

    def keep(self, s: Session, held: int, points: int, new_audio: list, new_points: list, cleared: bool) -> None:
        """Append what is new; write a list anew where it was cleared, or holds half as much again as its window."""
        added = sum(map(len, new_audio))
        if cleared or held + added > 1.5 * MAX_SECONDS * s.sr:
            self.audio.clear()
            held = len(s.buffer)
            if held:
                self.audio.put([(s.buffer.tobytes(),)])
        elif added:
            self.audio.appendList([(x.astype(np.float32).tobytes(),) for x in new_audio])
            held += added
        if len(new_points) and (cleared or points + len(new_points) > 1.5 * len(s.history)):
            self.history.put([tuple(map(float, p)) for p in s.history])
            points = len(s.history)
        elif new_points:
            self.history.appendList(new_points)
            points += len(new_points)
        elif cleared:
            self.history.clear()
            points = 0
        self.flags.update((int(s.sr), bool(s.has_speech), float(s.last_t), int(held), int(points)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.flags, self.audio, self.history):
            state.clear()
        yield pd.DataFrame({"session": pd.Series([], dtype=str), "t": [], "silence": [], "p_eot": [], "status": pd.Series([], dtype=str)}).astype({"t": float, "silence": float, "p_eot": float})

    def close(self) -> None:
        pass


def live(chunks: DataFrame, policy: Policy = Policy(), predict=heuristic, at: str | None = None, idle_ms: int = IDLE_MS, late: str = "1 minute") -> DataFrame:
    """Events of a stream of chunks (session, t, sr, samples), as ``detector.detect``: stale and repeated chunks are dropped, a reset gives none.

    at: the column with the time of sending, whose watermark ends idle sessions.
    """
    stateful(chunks.sparkSession)
    rows = chunks if at is None else chunks.withWatermark(at, late)
    return rows.groupBy("session").transformWithStateInPandas(Detector(policy, predict, at, idle_ms), EVENTS, "Append", "None" if at is None else "EventTime")


class Requests(StatefulProcessor):
    """A session's requests and answers to replies: one for each request that is the newest when its answer or its deadline comes."""

    def __init__(self, deadline_ms: int, gate: float):
        self.deadline_ms, self.gate = deadline_ms, gate

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "request_id long, sent long, open boolean, fallen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        request, sent, waits, fallen = self.newest.get() or (-1, 0, False, False)
        out = []
        told = pd.concat(list(rows))
        told = told.assign(ms=told["at"].astype("datetime64[ms]").astype("int64"), answer=told["kind"] == "answer").sort_values(["ms", "answer", "request_id"], kind="stable")
        for r in told.itertuples():
            if waits and r.ms > sent + self.deadline_ms:  # the deadline passed before this came
                out.append((key[0], request, None, "fallback"))
                waits, fallen = False, True
            if not r.answer:
                if r.request_id > request and r.silence >= self.gate and not fallen:
                    request, sent, waits = int(r.request_id), int(r.ms), True
                    self.handle.registerTimer(sent + self.deadline_ms + 1)
            elif waits and r.request_id == request:
                out.append((key[0], request, float(r.p_eot), "answered"))
                waits = False
        self.newest.update((request, sent, waits, fallen))
        yield replies(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        request, sent, waits, fallen = self.newest.get() or (-1, 0, False, False)
        out = []
        if waits and expiredTimerInfo.getExpiryTimeInMs() >= sent + self.deadline_ms:
            out.append((key[0], request, None, "fallback"))
            self.newest.update((request, sent, False, True))
        yield replies(out)

    def close(self) -> None:
        pass


def replies(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "request_id", "p_eot", "status"]).astype({"request_id": "int64", "p_eot": "float64"})


def answered(events: DataFrame, deadline_ms: int = DEADLINE_MS, gate: float = GATE, late: str = "1 second") -> DataFrame:
    """Replies from a stream of (session, kind, request_id, at, silence, p_eot); kind is request or answer.

    The newest request wins: an answer to another one gives nothing, in whatever batch it comes. A request in a pause under ``gate`` seconds is none. One that has no
    answer ``deadline_ms`` after it was sent falls back, as its timer tells, and the session's later requests are left to the fallback.
    """
    stateful(events.sparkSession)
    rows = events.withWatermark("at", late)
    return rows.groupBy("session").transformWithStateInPandas(Requests(deadline_ms, gate), REPLIES, "Append", "EventTime")
