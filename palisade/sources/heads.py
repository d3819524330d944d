"""The first bytes of objects by ranged reads: a Python data source, batch and stream, with one partition per object.

    spark.dataSource.register(ObjectHeads)
    spark.read.format("object_heads").option("paths", json.dumps([...])).option("bytes", 2048).load()

No more than ``bytes`` bytes of an object are asked for, however long the object or its first line is.  A stream's offset is a
place in the list of paths: the next batch are the objects that the list has gained since (a list only grows at its end).
"""

from __future__ import annotations

import json
import re
import sys
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, size bigint, head binary"


def location(path: str):
    """File system and path of an object as Spark names it (``file:/a b``, ``s3://bucket/key``, ``/a``)."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def head(path: str, most: int) -> tuple[str, int, bytes]:
    system, name = location(path)
    with system.open_input_file(name) as f:
        size = f.size()
        return path, size, f.read_at(min(most, size), 0)


class _Object(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Heads:
    def __init__(self, options):
        self.options = options
        self.most = int(options.get("bytes", 2048))

    def paths(self) -> list[str]:
        """The list itself (``paths``, JSON) or what a file of one path per line (``listing``) holds now."""
        if "listing" not in self.options:
            return json.loads(self.options.get("paths", "[]"))
        system, name = location(self.options["listing"])
        with system.open_input_stream(name) as f:
            return [p for p in f.read().decode().split("\n") if p]

    def read(self, partition):
        yield head(partition.path, self.most)


class _Batch(_Heads, DataSourceReader):
    def partitions(self):
        return [_Object(p) for p in self.paths()]


class _Stream(_Heads, DataSourceStreamReader):
    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        return {"n": len(self.paths())}

    def partitions(self, start, end):
        return [_Object(p) for p in self.paths()[start["n"]:end["n"]]]


class ObjectHeads(DataSource):
    @classmethod
    def name(cls):
        return "object_heads"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
