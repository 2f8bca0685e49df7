"""A data source for FeatureCollection files that reads one file in several tasks.

A FeatureCollection is one JSON value, which Spark's JSON reader gives to one task.  This source cuts a file into
byte ranges.  A task begins at the first feature that starts in its range, reads on past the end until its last
feature is whole, and gives each feature as a line of JSON, so a schema or inference applies as to any
JSON lines.  A feature is an object whose ``type`` is ``Feature`` and that has a ``geometry`` and ``properties``; where
a range begins inside one, its inner objects are passed over since they are none.

Files are opened through Arrow's file systems (local paths and ``file:``, ``hdfs:``, ``s3:``, ``gs:`` URIs).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: Bytes of a range.
SPLIT_BYTES = 64 << 20
#: Bytes that a task reads at a time.
READ_BYTES = 1 << 20

_HEAD = b'"features"'
_SIGN = re.compile(rb'["{}]')
_STRING = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """Files and sizes: the path itself, or a folder's files whose names begin with neither ``_`` nor ``.``."""
    from pyarrow import fs

    system, at = _file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def object_end(body: bytearray, at: int, memory: dict) -> int:
    """End of the object that opens at ``at``, or -1 where the body ends before; strings are respected.  ``memory`` holds
    how far an earlier call got, so that a longer body is read on and not again."""
    i, depth = memory.get(at, (at, 0))
    while m := _SIGN.search(body, i):
        sign = body[m.start()]
        if sign == 0x22:  # a string opens; it may end behind the body
            i = _string_end(body, m.end())
            if i < 0:
                memory[at] = (m.start(), depth)
                return -1
        else:
            depth += 1 if sign == 0x7B else -1
            i = m.end()
            if not depth:
                return i
    memory[at] = (len(body), depth)
    return -1


def _string_end(body: bytearray, at: int) -> int:
    """Place behind the quote that ends the string whose content begins at ``at``, or -1."""
    m = _STRING.match(body, at)
    return m.end() if m else -1


def features(read, start: int, end: int, size: int) -> Iterator[dict]:
    """Features that start in [start, end); ``read(at, n)`` gives bytes of the file."""
    body, base = bytearray(), start  # the body begins at place ``base`` of the file

    def more() -> bool:
        got = read(base + len(body), READ_BYTES) if base + len(body) < size else b""
        body.extend(got)
        return bool(got)

    at = 0
    if start == 0:  # the collection's own object opens first; its features stand behind their key
        while (found := body.find(_HEAD)) < 0 and more():
            pass
        at = max(0, found)
    while base + at < end:
        opens = body.find(b"{", at)
        if opens < 0:
            at = len(body)
            if base + at >= end or not more():
                return
            continue
        if base + opens >= end:
            return
        memory: dict = {}
        while (close := object_end(body, opens, memory)) < 0 and more():
            pass
        got = None
        if close >= 0:
            try:
                got = json.loads(bytes(body[opens:close]))
            except ValueError:
                got = None
        if isinstance(got, dict) and got.get("type") == "Feature" and "geometry" in got and "properties" in got:
            yield got
            at = close
        else:
            at = opens + 1
        if at > 4 * READ_BYTES:
            del body[:at]
            base, at = base + at, 0


def collection_lines(batches: Iterator) -> Iterator:
    """Arrow batches of features as JSON text -> the lines of one FeatureCollection: a comma before every feature but the first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def lines(values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values], ["value"])

    yield lines(pa.array(['{"type":"FeatureCollection","features":['], pa.string()))
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).cast(pa.string())
        if first:
            yield lines(values.slice(0, 1))
            values, first = values.slice(1), False
        yield lines(pc.binary_join_element_wise(pa.scalar(",", pa.string()), values, pa.scalar("", pa.string())))
    yield lines(pa.array(["]}"], pa.string()))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return [_Range(p, a, min(a + self.split, n), n) for p, n in _files(self.path) for a in range(0, n, self.split)]

    def read(self, partition):
        if partition is None:  # a folder without files
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as f:
            for feature in features(lambda at, n: f.read_at(min(n, partition.size - at), at), partition.start, partition.end, partition.size):
                yield (json.dumps(feature, ensure_ascii=False, separators=(",", ":")),)


class FeatureCollectionSource(DataSource):
    """``spark.read.format("feature_collection").option("splitBytes", n).load(path)``: one column ``feature``, JSON text."""

    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def schema(self) -> str:
        return "feature string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FeatureCollectionSource)
