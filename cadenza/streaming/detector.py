"""End-of-turn events from a stream of audio chunks, with state per session.

Chunks have ``session, t, sr, samples``: t is the chunk's end in the session's own time, which
is all the time there is. A session's state is its last ``MAX_SECONDS`` of audio, two flags and the histories of
scores and loudness, so it stays bounded however long the session runs; where chunks tell when they were sent, a session that sends nothing for ``IDLE_MS`` is forgotten.
A chunk without samples (null) is a control message: the session begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_SECONDS, FLOOR_DB, MIN_SPEECH, MIN_SILENCE, FRAME = 30.0, -80.0, 0.2, 0.1, 0.02
HISTORY_SECONDS, HISTORY, IDLE_MS, DEADLINE = 30.0, 2000, 3_600_000, 1.0
EVENTS = "session string, t double, silence double, p_eot double, status string"
STATE = "buffer binary, sr int, has_speech boolean, last_t double, history binary"


def loud(x: np.ndarray, sr: int) -> np.ndarray:
    """Which whole frames, counted from the start, are above the floor."""
    size = max(1, int(sr * FRAME))
    n = len(x) // size
    rms = np.sqrt(np.mean(np.square(x[: n * size].reshape(n, size).astype(np.float64)), 1)) if n else np.zeros(0)
    return 20 * np.log10(rms + 2e-9) > FLOOR_DB


def trailing_silence(flags: np.ndarray) -> float:
    at = np.flatnonzero(flags)
    return (len(flags) - 1 - (at[-1] if len(at) else -1)) * FRAME


def sustained(flags: np.ndarray) -> bool:
    need = max(1, round(MIN_SPEECH / FRAME))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return bool(len(edge)) and int((edge[1::2] - edge[::2]).max()) >= need


def heuristic(x: np.ndarray, sr: int) -> float:
    return float(1 - np.exp(-trailing_silence(loud(x, sr)) / 0.6))


class Policy:
    def __init__(self, threshold: float = 0.5, action_delay: float = 0.2, timeout: float = 3.0):
        self.threshold, self.action_delay, self.timeout = threshold, action_delay, timeout

    def decide(self, p: float, silence: float) -> str:
        if silence <= 0:
            return "listening"
        if silence >= self.timeout:
            return "end_of_turn (timeout)"
        return "end_of_turn" if silence >= self.action_delay and p >= self.threshold else "holding"


class Session:
    """history has rows (t, score, loudness of the chunk), of the last HISTORY_SECONDS and at most HISTORY."""

    def __init__(self, buffer: bytes = b"", sr: int = 16000, has_speech: bool = False, last_t: float = 0.0, history: bytes = b""):
        self.buffer, self.sr, self.has_speech, self.last_t = np.frombuffer(buffer, np.float32), sr, has_speech, last_t
        self.history = np.frombuffer(history, np.float64).reshape(-1, 3)

    def state(self) -> tuple:
        return self.buffer.tobytes(), int(self.sr), bool(self.has_speech), float(self.last_t), self.history.tobytes()

    def remember(self, t: float, p: float, chunk: np.ndarray):
        """Add to the history and evict what is too old, but never the newest row."""
        rms = np.sqrt(np.mean(np.square(chunk.astype(np.float64)))) if chunk.size else 0.0
        rows = np.concatenate([self.history, [[t, p, 20 * np.log10(rms + 2e-9) if chunk.size else -120.0]]])
        self.history = rows[t - rows[:, 0] <= HISTORY_SECONDS][-HISTORY:]

    def step(self, t: float, sr: int, chunk, policy: Policy, predict=heuristic) -> tuple[float, float, str]:
        """Take a chunk; silence, score and status. An end of turn clears the buffer and the speech flag."""
        chunk = np.asarray(chunk, np.float32)
        if chunk.size and np.abs(chunk).max() > 4:
            chunk = chunk / np.float32(32768)
        out = self._heard(t, sr, chunk, policy, predict)
        self.remember(t, out[1], chunk)
        return out

    def _heard(self, t: float, sr: int, chunk: np.ndarray, policy: Policy, predict) -> tuple[float, float, str]:
        self.sr, self.last_t = sr, t
        self.buffer = np.concatenate([self.buffer, chunk])[-int(MAX_SECONDS * sr) :]
        flags = loud(self.buffer, sr)
        silence = trailing_silence(flags)
        self.has_speech = self.has_speech or sustained(flags)
        if not self.has_speech or silence <= 0 or silence < MIN_SILENCE:
            return silence, 0.0, "listening"
        p = predict(self.buffer, sr)
        status = policy.decide(p, silence)
        if status.startswith("end_of_turn"):
            self.buffer, self.has_speech = np.zeros(0, np.float32), False
        return silence, p, status


def as_mono(samples) -> np.ndarray:
    """Samples, or frames of one sample for each channel, as one channel; integers as shares of their type's largest value."""
    x = np.asarray([np.asarray(v) for v in samples]) if len(samples) and np.ndim(samples[0]) else np.asarray(samples)
    if x.ndim == 2:
        x = x.mean(1)
    elif np.issubdtype(x.dtype, np.integer) and x.size:
        x = x / np.iinfo(x.dtype).max
    return x.astype(np.float32)


def detect(chunks: DataFrame, policy: Policy = Policy(), predict=heuristic, at: str | None = None, idle_ms: int = IDLE_MS, late: str = "1 minute") -> DataFrame:
    """Events of a stream of chunks, one per chunk; a reset gives none.

    A chunk no newer than the session's last one is stale or a repeat (a source that sends again after a failure), and dropped.
    at names a column with the time of sending: the watermark on it, which waits for chunks that are late, ends sessions that have been idle.
    """
    if at is not None:
        chunks = chunks.withWatermark(at, late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = Session(*state.get) if state.exists else Session()
        out = []
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        for r in rows.itertuples():
            if r.t <= s.last_t:
                continue
            if r.samples is None:
                s = Session(last_t=r.t)
            else:
                out.append((key[0], r.t, *s.step(r.t, r.sr, as_mono(r.samples), policy, predict)))
        state.update(s.state())
        if at is not None:
            newest = int(rows[at].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["session", "t", "silence", "p_eot", "status"])

    return chunks.groupBy("session").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout if at is None else GroupStateTimeout.EventTimeTimeout)


def replay(files: DataFrame, policy: Policy = Policy(), predict=heuristic, chunk_seconds: float = 0.3) -> DataFrame:
    """Events of whole recordings (session, sr, samples), cut into chunks; a file is one row, so nothing shuffles.

    A recording that stops in a pause after speech ends with ``end_of_turn (end of recording)``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x, s, size = np.asarray(r.samples, np.float32), Session(), int(chunk_seconds * r.sr)
                status = "listening"
                for k, at in enumerate(range(0, len(x), max(size, 1))):
                    silence, p, status = s.step((k + 1) * chunk_seconds, r.sr, x[at : at + size], policy, predict)
                    out.append((r.session, (k + 1) * chunk_seconds, silence, p, status))
                if s.has_speech and len(s.buffer) and trailing_silence(loud(s.buffer, r.sr)) > 0:
                    out.append((r.session, len(x) / r.sr, trailing_silence(loud(s.buffer, r.sr)), 0.0, "end_of_turn (end of recording)"))
            yield pd.DataFrame(out, columns=["session", "t", "silence", "p_eot", "status"])

    return files.select("session", "sr", "samples").mapInPandas(run, EVENTS)


def subtitles(events: DataFrame) -> DataFrame:
    """Ends of turn as numbered captions of 0.2 seconds."""
    ends = events.where("status LIKE 'end_of_turn%'")
    k = F.row_number().over(Window.partitionBy("session").orderBy("t"))
    return ends.select("session", F.concat(F.lit("EOT #"), k.cast("string")).alias("text"), F.greatest(F.lit(0.0), F.col("t") - 0.1).alias("start"), (F.col("t") + 0.1).alias("end"))


def latest(requests: DataFrame, deadline: float = DEADLINE) -> DataFrame:
    """Of each session's scoring requests, the newest wins. If the request tells its seconds, ``took``, an answer after the deadline is none: its p_eot is null."""
    p = F.when(F.col("took") <= deadline, F.col("p_eot")) if "took" in requests.columns else F.col("p_eot")
    newest = F.max_by(F.struct(p.alias("p")), "request_id")
    return requests.groupBy("session").agg(F.max("request_id").alias("request_id"), newest["p"].alias("p_eot"))
