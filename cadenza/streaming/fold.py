"""The session automaton in the JVM: frames of a whole recording to events, without Python, by running sums over its chunks.

A recording is a string of whole 20 ms frames, 1 loud and 0 quiet. Chunks of 0.3 s are 15 frames, so what a chunk changes follows from it and four
numbers: the quiet frames so far at the end, the loud ones, whether speech has been latched, and how many frames the buffer holds at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = 0.02
CHUNK, WINDOW, SPEECH, PAUSE = 15, 1500, 10, 5  # frames: of a chunk, of the buffer, of sustained speech, of a pause that is scored
SPAN = 4096  # chunks of a recording that are cut at once
STATUS = {"L": "listening", "H": "holding", "E": "end_of_turn", "T": "end_of_turn (timeout)"}


def frames_of(loud: Column, quiet: Column) -> Column:
    """Loud frames, then quiet ones."""
    return F.concat(F.repeat(F.lit("1"), loud), F.repeat(F.lit("0"), quiet))


def score(silent: Column) -> Column:
    """The heuristic predictor."""
    return 1 - F.exp(-(silent * FRAME) / 0.6)


def chunked(recordings: DataFrame) -> DataFrame:
    """(session, n, k, size, loud, quiet, tail, lead, last, sustained): what each chunk of frames is by itself; n is the recording's length.

    Chunks are cut from spans, so that no row holds all of a long recording's. The length is taken first: beside an explode the frames would be kept with each chunk.
    """
    cut = lambda c, n: F.posexplode(F.regexp_extract_all(c, F.lit(f"[01]{{1,{n}}}"), F.lit(0)))
    spans = recordings.select("session", "frames", F.length("frames").alias("n")).select("session", "n", cut("frames", SPAN * CHUNK).alias("span", "frames"))
    rows = spans.select("session", "n", "span", cut("frames", CHUNK).alias("place", "c")).withColumn("k", F.col("span") * SPAN + F.col("place"))
    size = F.length("c")
    before, after = (lambda x: F.length(F.substring_index("c", x, 1))), (lambda x: F.length(F.substring_index("c", x, -1)))  # the first, the last of x; all where there is none
    return rows.select(
        "session", "n", "k", size.alias("size"), F.contains("c", F.lit("1")).alias("loud"), F.contains("c", F.lit("0")).alias("quiet"),
        after("1").alias("tail"), before("0").alias("lead"), after("0").alias("last"), F.contains("c", F.lit("1" * SPEECH)).alias("sustained"),
    )


def steps(recordings: DataFrame, threshold: float = 0.5, action_delay: float = 0.2, timeout: float = 3.0) -> DataFrame:
    """(session, n, k, silent, has_speech, status), one row a chunk. An end of turn empties the buffer and the latch, which a row tells as they were before.

    A stretch of silence ends a turn once at most, in its first chunk that is long enough, if speech was latched since the last stretch that was;
    so all that a chunk needs of those before are sums and latest places.
    """
    act, end = round(action_delay / FRAME), round(timeout / FRAME)
    w = Window.partitionBy("session").orderBy("k")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda c, of: F.coalesce(F.last(c, ignorenulls=True).over(of), F.lit(0))
    acts = lambda s: (s >= PAUSE) & ((s >= end) | ((s >= act) & (score(s) >= threshold)))
    at, start = F.least((F.col("k") + 1) * CHUNK, F.col("n")), F.col("k") * CHUNK
    silence, speech = F.when(F.col("loud"), F.col("tail") - at), F.when(F.col("quiet"), F.col("last") - at)
    sums = {"pause": at + latest(silence, so_far), "pause_before": start + latest(silence, before), "run_before": start + latest(speech, before)}
    rows = chunked(recordings).withColumns(sums).withColumns({c: F.least(F.col(c), F.lit(WINDOW)) for c in ("pause", "pause_before")})
    rows = rows.withColumn("long", acts(F.col("pause")) & (F.col("loud") | ~acts(F.col("pause_before"))))
    rows = rows.withColumn("sustained", F.col("sustained") | (F.col("run_before") + F.col("lead") >= SPEECH))
    place = lambda c, of: F.coalesce(F.max(F.when(F.col(c), F.col("k"))).over(of), F.lit(-1))
    rows = rows.withColumn("has_speech", place("sustained", so_far) > place("long", before))
    emptied = F.when(F.col("long") & F.col("has_speech"), -at).when(F.col("loud"), F.col("tail") - at)
    silent = F.when(F.col("loud"), F.col("tail")).otherwise(F.least(at + latest(emptied, before), F.lit(WINDOW))).cast("int")
    rows = rows.withColumn("silent", silent)
    s = F.col("silent")
    status = F.when(~F.col("has_speech") | (s < PAUSE), STATUS["L"]).when(s >= end, STATUS["T"]).when(acts(s), STATUS["E"]).otherwise(STATUS["H"])
    return rows.select("session", "n", "k", "silent", "has_speech", status.alias("status"))


def replayed(recordings: DataFrame, **policy: float) -> DataFrame:
    """(session, k, t, silent, has_speech, p_eot, status) of recordings (session, frames), one row a chunk, and one more where a recording stops in a pause after speech.

    Sessions differ. t is the chunk's end by its number, also for a short last chunk; the last event's is the recording's length. A null or empty recording has no rows.
    """
    rows = steps(recordings, **policy)
    told = lambda k, t, p, status: F.struct(k.alias("k"), t.alias("t"), p.alias("p_eot"), status.alias("status"))
    scored = F.when(F.col("status") == STATUS["L"], 0.0).otherwise(score(F.col("silent")))
    live = told(F.col("k"), (F.col("k") + 1) * 0.3, scored, F.col("status"))
    stops = told(F.col("k") + 1, F.col("n") * FRAME, F.lit(0.0), F.lit("end_of_turn (end of recording)"))
    last = (F.col("k") == F.ceil(F.col("n") / CHUNK) - 1) & F.col("has_speech") & (F.col("silent") > 0) & ~F.col("status").startswith("end_of_turn")
    out = rows.select("session", "silent", "has_speech", F.explode(F.when(last, F.array(live, stops)).otherwise(F.array(live))).alias("x"))
    return out.select("session", "x.k", "x.t", "silent", "has_speech", "x.p_eot", "x.status")


def captions(events: DataFrame) -> DataFrame:
    """Ends of turn as numbered captions of 0.2 seconds."""
    ends = events.where(F.col("status").startswith("end_of_turn"))
    number = F.row_number().over(Window.partitionBy("session").orderBy("k"))
    return ends.select("session", F.concat(F.lit("EOT #"), number.cast("string")).alias("text"), F.greatest(F.lit(0.0), F.col("t") - 0.1).alias("start"), (F.col("t") + 0.1).alias("end"))
