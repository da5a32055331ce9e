"""Audio members of zip archives as a Spark data source that reads byte ranges.

    archives(spark, "/shared/archives", prefix="ms-").where("member LIKE 'talk-%'")

Planning reads each archive's directory once (its last bytes), drops members by what is asked of their names, and deals the rest
to partitions of about ``RANGE`` compressed bytes, so that a large archive is many tasks. A task opens the archive and reads the
ranges of its members, neighbours in one request, and nothing else; a member is checked against its CRC. Paths can be any that Arrow's file systems
know (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

RANGE = 64 << 20  # compressed bytes of a partition, unless one member has more
JOINED = 1 << 20  # a gap between members up to which one request reads both
HEADER = 30  # bytes of a member's own header before its name, a fixed value
SCHEMA = "archive string, member string, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


@dataclass
class Member:
    name: str
    offset: int
    packed: int
    size: int
    method: int
    crc: int


@dataclass
class Archive(InputPartition):
    """Members of one archive, in order of their places; end: where its directory begins."""

    path: str
    members: list[Member]
    end: int


def discover(folder: str, prefix: str = "", count: int | None = None) -> list[str]:
    """Names of the archives with a prefix, sorted, the first count of them."""
    store, at = opened(folder)
    found = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.startswith(prefix) and f.base_name.endswith(".zip"))
    return found[:count]


def directory(path: str) -> tuple[list[Member], int]:
    """An archive's members by their places, and where its directory begins, from its last bytes alone."""
    store, at = opened(path)
    with store.open_input_file(at) as f, zipfile.ZipFile(io.BufferedReader(f, 1 << 16)) as z:
        found = [Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir()]
        return sorted(found, key=lambda m: m.offset), z.start_dir


def ranges(members: list[Member], limit: int = RANGE) -> Iterator[list[Member]]:
    """Runs of members of about limit compressed bytes."""
    own, size = [], 0
    for m in members:
        if own and size + m.packed > limit:
            yield own
            own, size = [], 0
        own.append(m)
        size += m.packed
    if own:
        yield own


def unpacked(m: Member, data: bytes) -> bytes:
    """A member's content from the bytes that begin with its header."""
    if data[:4] != b"PK\3\4":
        raise OSError(f"no member where the directory tells of {m.name}")
    name, extra = struct.unpack("<HH", data[26:HEADER])
    body = data[HEADER + name + extra : HEADER + name + extra + m.packed]
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise OSError(f"{m.name} is packed by method {m.method}, which is not supported")
    content = body if m.method == zipfile.ZIP_STORED else zlib.decompress(body, -15)
    if len(content) != m.size or zlib.crc32(content) != m.crc:
        raise OSError(f"{m.name} is damaged")
    return content


def contents(f: pa.NativeFile, members: list[Member], end: int) -> Iterator[tuple[str, bytes]]:
    """Names and contents of members in order of their places. A member's own header may be longer than the directory tells, so a range ends where the next begins."""
    k = 0
    while k < len(members):
        first, last = k, k
        stop = lambda m: m.offset + HEADER + len(m.name.encode()) + m.packed
        while last + 1 < len(members) and members[last + 1].offset - stop(members[last]) <= JOINED and members[last + 1].offset - members[first].offset <= RANGE:
            last += 1
        # up to 64 KB for what the last member's header has beyond its name
        to = min(end, stop(members[last]) + (1 << 16))
        f.seek(members[first].offset)
        data = memoryview(f.read(to - members[first].offset))
        for m in members[first : last + 1]:
            yield m.name, unpacked(m, data[m.offset - members[first].offset :])
        k = last + 1


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.prefix = options.get("prefix", "")
        self.count = int(options["archives"]) if options.get("archives") else None
        self.range = int(options.get("range", RANGE))
        self.asked: list[tuple[str, Filter]] = []

    def wanted(self, column: str, value: str) -> bool:
        """Does a name pass all pushed conditions on its column?"""
        tests = {
            EqualTo: lambda f: value == f.value,
            In: lambda f: value in f.value,
            StringStartsWith: lambda f: value.startswith(f.value),
            StringEndsWith: lambda f: value.endswith(f.value),
            StringContains: lambda f: f.value in value,
        }
        return all(tests[type(f)](f) for c, f in self.asked if c == column)

    def partitions(self):
        names = [n for n in discover(self.folder, self.prefix, self.count) if self.wanted("archive", n)]
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(lambda n: directory(posixpath.join(self.folder, n)), names))
        parts = [Archive(posixpath.join(self.folder, n), own, end) for n, (members, end) in zip(names, found, strict=True) for own in ranges([m for m in members if self.wanted("member", m.name)], self.range)]
        return parts or [Archive("", [], 0)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.members:
            return
        store, at = opened(partition.path)
        archive, own, size = posixpath.basename(partition.path), [], 0
        as_batch = lambda own: pa.RecordBatch.from_pydict({"archive": pa.array([archive] * len(own)), "member": pa.array([n for n, _ in own]), "content": pa.array([c for _, c in own], pa.binary())})
        with store.open_input_file(at) as f:
            for name, content in contents(f, partition.members, partition.end):
                own.append((name, content))
                size += len(content)
                if size >= 8 << 20:
                    yield as_batch(own)
                    own, size = [], 0
        if own:
            yield as_batch(own)


class FilteringReader(ZipReader):
    """Takes conditions on the names: equal, one of, and parts of them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute in (("member",), ("archive",)):
                self.asked.append((f.attribute[0], f))
            else:
                yield f


class ZipAudio(DataSource):
    """Options: prefix and archives (which archives), range (bytes of a partition), push ("true": take conditions, where the session lets sources do that)."""

    @classmethod
    def name(cls):
        return "zipaudio"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (FilteringReader if self.options.get("push") == "true" else ZipReader)(self.options)


def archives(spark: SparkSession, folder: str, prefix: str = "", count: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(archive, member, content) of a folder's archives; conditions on the names decide what is read."""
    spark.dataSource.register(ZipAudio)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("zipaudio").option("push", "true").option("prefix", prefix).option("range", range_bytes)
    return (reader.option("archives", count) if count is not None else reader).load(folder)


def first_wins(members: DataFrame) -> DataFrame:
    """One row for each member: that of the first archive by name."""
    w = Window.partitionBy("member").orderBy("archive")
    return members.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
