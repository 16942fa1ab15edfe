"""Members of ZIP archives as a data source: ``spark.read.format("zip_members")`` after ``register(spark)``."""

from __future__ import annotations

import glob
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "archive string, member string, size long, content binary, error string"


class Members(InputPartition):
    """Members ``start`` up to ``stop`` of an archive, by their place in its directory."""

    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class ZipReader(DataSourceReader):
    """A task a range of members; the driver reads the archives' directories alone."""

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.paths = sorted(glob.glob(options["path"].removeprefix("file://")))
        self.most = int(options.get("membersPerTask", "1000"))
        self.first = int(options["first"]) if "first" in options else None

    def partitions(self) -> list[Members]:
        out = []
        for path in self.paths:
            try:
                with zipfile.ZipFile(path) as z:
                    n = sum(not i.is_dir() for i in z.infolist())
            except (zipfile.BadZipFile, OSError):
                # One task says that the archive is bad.
                out.append(Members(path, 0, -1))
                continue
            n = n if self.first is None else min(n, self.first)
            out += [Members(path, at, min(at + self.most, n)) for at in range(0, n, self.most)]
        return out or [Members("", 0, 0)]

    def read(self, part: Members) -> Iterator[tuple]:
        if part.stop < 0:
            yield self._row(archive=part.archive, error="not an archive")
            return
        if part.start >= part.stop:
            return
        with zipfile.ZipFile(part.archive) as z:
            for info in [i for i in z.infolist() if not i.is_dir()][part.start : part.stop]:
                content, error = None, None
                # Members are unpacked only if their content, or whether they are whole, is asked for.
                if "content" in self.names or "error" in self.names:
                    try:
                        content = z.read(info)
                    except Exception as e:  # a member may be broken in any way; it is named and counted
                        error = f"{type(e).__name__}: {e}"
                yield self._row(archive=part.archive, member=info.filename, size=info.file_size, content=content, error=error)

    def _row(self, **values) -> tuple:
        return tuple(values.get(n) for n in self.names)


class ZipMembers(DataSource):
    """archive, member, size, content, error; a read with a schema of some of them unpacks only what these need.

    Options: path (a glob in a folder that driver and executors share), membersPerTask, and
    first, for the first members of each archive alone. Members and archives that cannot be
    read have an error and no content.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        unknown = set(schema.fieldNames()) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no columns of archive members: {sorted(unknown)}")
        return ZipReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)
