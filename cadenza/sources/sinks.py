"""Turn rows to files, and what goes beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COLUMNS = ["id", "audio", "language", "duration", "silence_spans", "words", "messages"]


def write_turns(rows: DataFrame, path: str, per_file: int = 20_000, max_rows: int | None = None, by: str | None = None) -> None:
    """Parquet in the fixed column order, per_file rows a file, with a schema description beside it.

    Fails on an empty table unless max_rows is given, which stops after so many rows.
    """
    rows = rows.select(*COLUMNS)
    if max_rows is None:
        if rows.isEmpty():
            raise ValueError("no turns to write")
    else:
        rows = rows.limit(max_rows)
    out = rows.write.option("maxRecordsPerFile", per_file)
    (out.partitionBy(by) if by else out).parquet(path)
    describe(rows.schema, rows.sparkSession, f"{path}/_features.json")


def describe(schema: StructType, spark, path: str) -> None:
    """The columns and their types as JSON, written where Spark writes."""
    _put(spark, path, json.dumps({f.name: f.dataType.simpleString() for f in schema}))


def _put(spark, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(text.encode())
    stream.close()


def write_bias_csv(records: DataFrame, path: str) -> None:
    records.select("id", "label", "duration", "p_eot").write.csv(path, header=True)


def report_json(metrics: DataFrame, args: dict) -> DataFrame:
    """One row: arguments and all metric rows as JSON. Metrics are a few rows."""
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(metrics.columns)))))
    return metrics.agg(F.concat(F.lit('{"args":' + json.dumps(args) + ',"metrics":'), rows, F.lit("}")).alias("report"))


def write_report(predictions: DataFrame, metrics: DataFrame, args: dict, path: str) -> None:
    """A folder with ``report.json`` (arguments, metrics, and where the predictions lie) and the predictions as JSON lines, written by the executors."""
    predictions.select("id", "language", "label", "p_eot").write.json(f"{path}/predictions")
    _put(metrics.sparkSession, f"{path}/report.json", report_json(metrics, args | {"predictions": f"{path}/predictions"}).first()["report"])


def card(rows: DataFrame, title: str) -> str:
    """A dataset card with rows per language; languages are few."""
    counts = sorted((r.language or "", r.n) for r in rows.groupBy("language").agg(F.count("*").alias("n")).collect())
    head = "\n".join(["---", "language:", *(f"- {k}" for k, _ in counts), "---"])
    table = "\n".join(["| language | rows |", "|-|-|", *(f"| {k} | {n:,} |" for k, n in counts), f"| total | {sum(n for _, n in counts):,} |"])
    return f"{head}\n\n# {title}\n\n{table}\n"
