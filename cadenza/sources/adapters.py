"""Tables to the shapes the operators read: words, waveforms, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.text import sentence_end

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The parquet files of a folder whose names match; fails where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
    if not list(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or ()):
        raise FileNotFoundError(f"no {pattern} in {path}")
    return spark.read.parquet(str(p))


def event_words(events: DataFrame) -> DataFrame:
    """A user's events as one recording, in microseconds: each lasts ``value`` milliseconds."""
    start = F.expr(MICROS)
    return events.select(F.col("user_id").alias("rec"), F.col("event_id").alias("pos"), F.col("event_type").alias("word"), start.alias("start"), (start + (F.col("value") * 1000).cast("long")).alias("end"))


def partitions(df: DataFrame, each: int, most: int | None = None, many: int = 4096) -> int:
    """Shuffle partitions as set, and as many more as keep an input of the size that Spark knows below ``each`` bytes a partition; ``most``: below so many where there would be over ``many``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = size // each if most is None else max(min(size // each, many), size // most)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), own if size < 1 << 60 else 0)


#: The order of a text's words: times follow the places.
TEXT_ORDER = ("pos",)


def text_words(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A text's words as one recording, in milliseconds: time by length, longer gaps after sentence ends. ``ends`` says which words end one.

    Texts are dealt by key before they become words, so that the windows over a recording's words need no shuffle of these. A task sorts its
    words, which take some fifty times the file's bytes, so it gets few texts.
    """
    documents = documents.select(key, "text").repartition(partitions(documents, 4 << 20, 64 << 20), key)
    split = F.array_remove(F.split("text", r"[ \t\n\r\f]+"), "")
    rows = documents.select(F.col(key).alias("rec"), F.posexplode(split).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))
    rows = rows.withColumn("ends", sentence_end(F.col("word")))
    n = F.length("word")
    lasts, gap = 60 * n, 40 + (37 * n) % 200 + F.when(F.col("ends"), 600).otherwise(0)
    before = Window.partitionBy("rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(lasts + gap).over(before), F.lit(0)).cast("long")
    rows = rows.withColumn("start", start)
    return rows.withColumn("end", (F.col("start") + lasts).cast("long"))


def waves(embeddings: DataFrame) -> DataFrame:
    """Short waveforms of 64 samples, at a nominal rate of 64 a second."""
    return embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")


def predictions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A score per labelled document; many are equal."""
    n = F.col("n_chars")
    joined = documents.select("doc_id", "lang", "n_chars").join(labels.select("doc_id", "quality"), "doc_id")
    return joined.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("quality").cast("double").alias("label"), (n / (n + F.lit(1000.0))).alias("p_eot"), (n / 1000.0).alias("duration"))
