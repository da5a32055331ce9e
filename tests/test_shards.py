"""Shards of an exact number of rows: counts and names, commit and abort, attempts that repeat or fail."""

import json
import os
import pathlib
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cadenza.sources import shards as H

ROOT = pathlib.Path(__file__).parent.parent


def files(path):
    return {n: pq.read_table(f"{path}/{n}").num_rows for n in sorted(os.listdir(path)) if n.endswith(".parquet")}


def rows(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"), F.array(F.struct(F.lit(0.5).alias("start"), F.lit(1.5).alias("end"))).alias("silence_spans"))


def test_exact_counts_and_names(spark, tmp_path):
    path = str(tmp_path / "data")
    H.write_shards(rows(spark, 1050).repartition(7), path, "ms-single", per_shard=200)
    assert files(path) == {f"ms-single-{k:05d}.parquet": 200 if k < 5 else 50 for k in range(6)}
    told = json.load(open(f"{path}/_manifest.json"))
    assert told["rows"] == 1050 and [x["rows"] for x in told["shards"]] == [200] * 5 + [50]
    assert [x["bytes"] for x in told["shards"]] == [os.path.getsize(f"{path}/{x['name']}") for x in told["shards"]]
    assert list(json.load(open(f"{path}/_features.json"))) == ["id", "v", "silence_spans"]
    assert sorted(os.listdir(path)) == sorted([*files(path), "_manifest.json", "_features.json"])
    back = spark.read.parquet(*(f"{path}/{n}" for n in files(path)))
    assert sorted(r.v for r in back.collect()) == list(range(1050))


def test_streams_limits_and_modes(spark, tmp_path):
    path = str(tmp_path / "data")
    H.write_shards(rows(spark, 1000), path, "k", per_shard=100, streams=3)
    found = files(path)
    for s in range(3):
        own = [n for n in found if n.startswith(f"k-s{s}-")]
        assert own == [f"k-s{s}-{n:05d}.parquet" for n in range(len(own))] and all(found[n] == 100 for n in own[:-1])
    assert sum(found.values()) == 1000
    with pytest.raises(Exception, match="there already"):
        H.write_shards(rows(spark, 50), path, "k", per_shard=100, streams=3)
    assert files(path) == found and not [n for n in os.listdir(path) if n.startswith("_staging")]
    H.write_shards(rows(spark, 50), path, "other", per_shard=40)
    H.write_shards(rows(spark, 900), path, "k", per_shard=300, streams=3, limit=250, mode="overwrite")
    assert files(path) == {"k-s0-00000.parquet": 250, "k-s1-00000.parquet": 250, "k-s2-00000.parquet": 250, "other-00000.parquet": 40, "other-00001.parquet": 10}
    assert json.load(open(f"{path}/_manifest.json"))["rows"] == 800


def test_empty_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        H.write_shards(rows(spark, 0), str(tmp_path / "a"), "k")
    H.write_shards(rows(spark, 0), str(tmp_path / "b"), "k", limit=10)
    assert files(tmp_path / "b") == {}


def batches(n):
    return iter([pa.RecordBatch.from_pydict({H.STREAM: pa.array([0] * 10, pa.int32()), H.NUMBER: pa.array([k // 2] * 10, pa.int32()), "v": pa.array(range(10))}) for k in range(n)])


def failing():
    yield from batches(3)
    raise RuntimeError("executor lost")


def test_attempts_that_repeat_or_fail_leave_nothing(tmp_path):
    path = str(tmp_path / "data")
    os.mkdir(path)
    writer = H.ShardWriter({"path": path, "key": "k"}, False)
    with pytest.raises(RuntimeError):
        writer.write(failing())
    writer.write(batches(5))  # a speculative attempt that another one beat
    good = writer.write(batches(5))
    writer.commit([good, None])
    assert files(path) == {"k-00000.parquet": 20, "k-00001.parquet": 20, "k-00002.parquet": 10}
    assert sorted(os.listdir(path)) == sorted([*files(path), "_manifest.json", "_features.json"])
    second = H.ShardWriter({"path": path, "key": "j"}, False)
    two = [second.write(batches(2)), second.write(batches(2))]
    with pytest.raises(ValueError, match="two tasks"):
        second.commit(two)
    third = H.ShardWriter({"path": path, "key": "j"}, False)
    third.write(batches(2))
    third.abort([])
    assert len(files(path)) == 3 and not [n for n in os.listdir(path) if n.startswith("_staging")]


RETRY = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from cadenza.sources import shards as H
spark = SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1] + "/wh").getOrCreate()
def once(batches):
    for k, b in enumerate(batches):
        yield b
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("executor lost")
rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
spark.dataSource.register(H.Shards)
out = H.sharded(rows, "id", 150).repartition(H.STREAM, H.NUMBER).sortWithinPartitions(H.STREAM, H.NUMBER, "rank").select(H.STREAM, H.NUMBER, "id", "v")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
out.mapInArrow(once, out.schema).write.format("shards").option("key", "k").option("streams", "false").mode("append").save(sys.argv[1] + "/data")
"""


def test_a_task_that_runs_again(tmp_path):
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    path = tmp_path / "data"
    assert files(path) == {f"k-{k:05d}.parquet": 150 if k < 6 else 100 for k in range(7)}
    assert sorted(v for n in files(path) for v in pq.read_table(path / n)["v"].to_pylist()) == list(range(1000))
    assert not [n for n in os.listdir(path) if n.startswith("_staging")]
