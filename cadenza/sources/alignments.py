"""Recordings with word alignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cadenza.functions.audio import wav_samples
from cadenza.functions.text import normalized, parse_timestamped, rezeroed


def embedded(rows: DataFrame, config: str, order: str, limit: int | None = None, mode: str = "single") -> DataFrame:
    """Rows of words (structs of strings) and audio: source_id, words, audio, mode. Rows without a valid word are left out.

    Audio that is encoded (binary) is decoded, with its rate in ``sr``, and rows whose bytes do not decode are left out.
    mode is the source's own, which ``rows.built`` takes where it is asked for auto. ``limit`` counts scanned rows in
    the order of a column, including those left out.
    """
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    out = rows.withColumn("words", normalized(F.col("words"))).where(F.size("words") > 0)
    if "audio" in out.columns and isinstance(out.schema["audio"].dataType, BinaryType):
        out = out.withColumn("_heard", wav_samples("audio")).where("_heard.samples IS NOT NULL")
        out = out.withColumn("audio", F.col("_heard.samples")).withColumn("sr", F.col("_heard.rate")).drop("_heard")
    return out.withColumn("source_id", F.concat(F.lit(f"{config}_"), F.col(order).cast("string"))).withColumn("mode", F.lit(mode))


def external(rows: DataFrame, members: DataFrame, mode: str, order: str, limit: int | None = None, max_scan: int | None = None) -> DataFrame:
    """Rows of parallel lists (texts, audio_filenames) with audio in archives: one recording per segment.

    Kept are rows of the mode at word level; lists pair up to the shorter; segments without words or
    without audio among ``members`` (member, content) are left out; in streaming mode times count from the first word.
    ``max_scan`` caps rows read, ``limit`` recordings given.
    """
    if max_scan is not None:
        rows = rows.orderBy(order).limit(max_scan)
    kept = rows.where((F.col("mode") == mode) & (F.col("level") == "word"))
    n = F.least(F.size("texts"), F.size("audio_filenames"))
    pairs = F.slice(F.arrays_zip("texts", "audio_filenames"), F.lit(1), n)
    parts = kept.where(n > 0).select(order, F.posexplode(pairs).alias("i", "p"))
    words = parse_timestamped(F.col("p.texts"))
    parts = parts.select(F.concat_ws("_", order, "i").alias("source_id"), F.col("p.audio_filenames").alias("member"), words.alias("words"), order, "i").where(F.size("words") > 0)
    if mode == "streaming":
        parts = parts.withColumn("words", rezeroed(F.col("words")))
    out = parts.join(members, "member")
    if limit is not None:
        out = out.orderBy(order, "i").limit(limit)
    return out.drop(order, "i")


SOURCES: dict[str, Callable[..., DataFrame]] = {"embedded": embedded, "external": external}
