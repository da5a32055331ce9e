"""Parquet shards of an exact number of rows, as a Spark data source that commits.

    spark.dataSource.register(Shards)
    write_shards(rows, "/shared/data", key="ms-single", streams=8)

Rows are ranked within their stream (``sampling.ranks``: no task ranks a whole stream), every ``per_shard`` ranks are a shard, and a shard lies in
one task, which writes it batch by batch. A task writes to a folder of this run's own, under names of its own attempt; only what committed attempts
tell is moved to ``{key}-s{stream}-{n:05d}.parquet``, then the manifest (``_manifest.json``) and the schema (``_features.json``) are written. What failed
or repeated attempts leave goes with the folder. Paths can be any that Arrow's file systems know (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cadenza.operators.sampling import draw, ranks

PER_SHARD = 20_000
STREAM, NUMBER = "_stream", "_shard"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """Shards of one attempt: staged path, final name, rows, bytes."""

    files: list[tuple[str, str, int, int]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.key, self.overwrite = options["path"].rstrip("/"), options["key"], overwrite
        self.streams = options.get("streams") == "true"
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def name(self, stream: int, number: int) -> str:
        return f"{self.key}{f'-s{stream}' if self.streams else ''}-{number:05d}.parquet"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(f"{self.staging}/{uuid.uuid4().hex}")  # an attempt's own
        done, out, now, rows, at = [], None, None, 0, ""

        def close():
            if out is not None:
                out.close()
                done.append((at, self.name(*now), rows, store.get_file_info(at).size))

        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(folder, recursive=True)
            stream, number = (batch.column(c).to_numpy() for c in (STREAM, NUMBER))
            data = batch.drop_columns([STREAM, NUMBER])
            begin = 0
            while begin < len(stream):
                shard = int(stream[begin]), int(number[begin])
                same = (stream[begin:] == shard[0]) & (number[begin:] == shard[1])
                count = len(same) if same.all() else int(same.argmin())
                if shard != now:
                    close()
                    now, rows, at = shard, 0, f"{folder}/{shard[0]}-{shard[1]}.parquet"
                    out = pq.ParquetWriter(at, data.schema, filesystem=store)
                out.write_batch(data.slice(begin, count))
                rows, begin = rows + count, begin + count
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        names = [f[1] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a shard came from two tasks: rows must be dealt by stream and shard")
        manifest = f"{folder}/_manifest.json"
        before = json.loads(store.open_input_stream(manifest).read()) if store.get_file_info(manifest).type == fs.FileType.File else {"shards": []}
        kept = [x for x in before["shards"] if not (self.overwrite and x["name"].startswith(f"{self.key}-"))]
        if clash := {x["name"] for x in kept} & set(names):
            self.abort(messages)
            raise ValueError(f"there already: {sorted(clash)[0]}")
        for x in before["shards"]:
            if x not in kept:
                store.delete_file(f"{folder}/{x['name']}")
        for at, name, _, _ in files:
            store.move(at, f"{folder}/{name}")
        told = kept + [{"name": name, "rows": rows, "bytes": size} for _, name, rows, size in files]
        self._put(store, manifest, {"shards": sorted(told, key=lambda x: x["name"]), "rows": sum(x["rows"] for x in told)})
        if files:
            schema = pq.read_schema(f"{folder}/{names[0]}", filesystem=store)
            self._put(store, f"{folder}/_features.json", {f.name: str(f.type) for f in schema})
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _put(self, store: fs.FileSystem, path: str, value: dict) -> None:
        with store.open_output_stream(path) as out:
            out.write(json.dumps(value).encode())

    def _clear(self) -> None:
        store, folder = opened(self.staging)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class Shards(DataSource):
    """Options: key (the names' first part), streams ("true" if names tell the stream); rows come with STREAM and NUMBER, sorted by them."""

    @classmethod
    def name(cls):
        return "shards"

    def writer(self, schema, overwrite):
        return ShardWriter(self.options, overwrite)


def sharded(rows: DataFrame, order: str, per_shard: int = PER_SHARD, streams: int | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """rows with their stream, shard and rank within the stream, by a hash of the order column; the first limit ranks of each stream.

    Every shard of a stream but its last has per_shard rows, whatever the partitions. Rows that share an order value are ranked in no stable order.
    """
    stream = (F.conv(F.substring(draw(F.col(order), seed), -4, 4), 16, 10).cast("int") % (streams or 1)).cast("int")
    ranked = ranks(rows.withColumn(STREAM, stream), order, [STREAM], seed)
    if limit is not None:
        ranked = ranked.where(F.col("rank") < limit)
    return ranked.withColumn(NUMBER, F.floor(F.col("rank") / per_shard).cast("int"))


def write_shards(rows: DataFrame, path: str, key: str, order: str = "id", per_shard: int = PER_SHARD, streams: int | None = None, limit: int | None = None, mode: str = "append") -> None:
    """Write shards of exactly per_shard rows; a table without rows is an error unless a limit is given."""
    if limit is None and rows.isEmpty():
        raise ValueError("no rows to write")
    rows.sparkSession.dataSource.register(Shards)
    out = sharded(rows, order, per_shard, streams, limit)
    out = out.repartition(STREAM, NUMBER).sortWithinPartitions(STREAM, NUMBER, "rank").select(STREAM, NUMBER, *rows.columns)
    out.write.format("shards").option("key", key).option("streams", str(streams is not None).lower()).mode(mode).save(path)
