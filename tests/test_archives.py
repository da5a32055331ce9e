"""Ranged reads of zip archives: contents, filters, partitions, bytes read, damage."""

import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.sources import zip_audio as Z


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("zips"), random.Random(1)
    held = {}
    for a, name in enumerate(("ms-0.zip", "ms-1.zip", "xx.zip")):
        with zipfile.ZipFile(path / name, "w") as z:
            z.comment = b"a comment " * 50
            z.mkdir("folder")
            for k in range(60):
                data = rng.randbytes(20_000 + 700 * k) if k % 3 else bytes(rng.choices(b"ab", k=30_000))
                info = zipfile.ZipInfo(f"folder/{'talk' if k % 20 == 0 else 'other'}-{k:03d}é.wav")
                info.extra = b"\xfe\xca" + (8).to_bytes(2, "little") + b"x" * 8 if k % 7 == 0 else b""
                z.writestr(info, data, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
                held[name, info.filename] = data
            z.writestr("empty.wav", b"")
            held[name, "empty.wav"] = b""
    return path, held


def rows(df):
    return {(r.archive, r.member): bytes(r.content) for r in df.collect()}


def test_all_members(spark, folder):
    path, held = folder
    assert rows(Z.archives(spark, str(path))) == held
    assert rows(Z.archives(spark, f"file://{path}", "ms-", 1)) == {k: v for k, v in held.items() if k[0] == "ms-0.zip"}


@pytest.mark.parametrize(
    "condition, keep",
    [
        ("member LIKE 'folder/talk-%'", lambda a, m: m.startswith("folder/talk-")),
        ("member IN ('empty.wav', 'folder/other-001é.wav', 'none')", lambda a, m: m in ("empty.wav", "folder/other-001é.wav")),
        ("member LIKE '%7é.wav' AND archive = 'xx.zip'", lambda a, m: m.endswith("7é.wav") and a == "xx.zip"),
        ("member LIKE '%-04%' AND length(content) > 40000", lambda a, m: "-04" in m),
        ("member = 'nowhere'", lambda a, m: False),
        ("archive LIKE 'ms-%' OR member = 'empty.wav'", lambda a, m: a.startswith("ms-") or m == "empty.wav"),
    ],
)
def test_conditions(spark, folder, condition, keep):
    path, held = folder
    got = rows(Z.archives(spark, str(path)).where(condition))
    want = {k: v for k, v in held.items() if keep(*k) and ("length" not in condition or len(v) > 40_000)}
    assert got == want


def test_partitions_follow_ranges(spark, folder):
    path, held = folder
    df = Z.archives(spark, str(path), range_bytes=200_000)
    assert rows(df) == held and df.rdd.getNumPartitions() > 12


class Counting:
    """A file that tells what was read of it."""

    def __init__(self, f, told):
        self.f, self.told = f, told

    def read(self, n=-1):
        out = self.f.read(None if n is None or n < 0 else n)
        self.told.append(len(out))
        return out

    def readinto(self, b):
        out = self.f.readinto(b)
        self.told.append(out)
        return out

    def __getattr__(self, name):
        return getattr(self.f, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()


def test_bytes_read(folder, monkeypatch):
    path, held = folder
    real, told = Z.opened, []

    class Store:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, at):
            return Counting(self.store.open_input_file(at), told)

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(Z, "opened", lambda p: (Store(real(p)[0]), real(p)[1]))
    monkeypatch.setattr(Z.io, "BufferedReader", lambda f, _: f)
    monkeypatch.setattr(Z, "JOINED", 1000)
    reader = Z.FilteringReader({"path": str(path), "prefix": "ms-0"})
    assert list(reader.pushFilters([Z.StringStartsWith(("member",), "folder/talk-")])) == []
    parts = reader.partitions()
    assert len(parts) == 1 and sum(told) < 75_000  # the directory, and what a comment may hide of it
    got = {n: bytes(c) for b in reader.read(parts[0]) for n, c in zip(b.column("member").to_pylist(), b.column("content").to_pylist(), strict=True)}
    want = {m: v for (a, m), v in held.items() if a == "ms-0.zip" and m.startswith("folder/talk-")}
    size = (path / "ms-0.zip").stat().st_size
    assert got == want and sum(told) < sum(map(len, want.values())) + 3 * 70_000 + 75_000 < size / 4
    everything = [b for p in Z.ZipReader({"path": str(path), "prefix": "ms-0", "range": 500_000}).partitions() for b in [p]]
    assert sum(len(p.members) for p in everything) == 61


def test_damage_is_an_error(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.wav", b"0123456789" * 10)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[50] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    reader = Z.ZipReader({"path": str(tmp_path)})
    with pytest.raises(OSError, match="damaged"):
        list(reader.read(reader.partitions()[0]))


def test_joins_segments_without_reading_the_rest(spark, folder):
    """Segments meet their members by name, the first archive wins, members that are missing drop the segment."""
    path, held = folder
    segments = spark.createDataFrame([(k, f"folder/other-{k:03d}é.wav") for k in (1, 2, 3, 999)], "n int, member string")
    wanted = [r.member for r in segments.collect()]
    members = Z.first_wins(Z.archives(spark, str(path)).where(F.col("member").isin(wanted)))
    got = {r.n: (r.archive, bytes(r.content)) for r in segments.join(members, "member").collect()}
    assert got == {k: ("ms-0.zip", held["ms-0.zip", f"folder/other-{k:03d}é.wav"]) for k in (1, 2, 3)}
