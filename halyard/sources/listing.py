"""Listings of object stores page by page, a task for each prefix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTED = "key string, size bigint, modified timestamp, prefix string, page int"
PAGE_KEYS = 1000


def page_of(fs, root: str, token: str | None, limit: int) -> tuple[list[tuple], str | None]:
    """Up to ``limit`` files below a root, those after the token, in order of their parts, and the token of the next page, if any.

    Folders are opened in order and one at a time, and those before the token not
    at all, so a page costs what it gives and what lies on the way to it.
    """
    from pyarrow.fs import FileSelector, FileType

    after = tuple(token.split("/")) if token else ()

    def below(folder: str, start: tuple[str, ...]) -> Iterator:
        for info in sorted(fs.get_file_info(FileSelector(folder, allow_not_found=True)), key=lambda x: x.base_name):
            name = info.base_name
            if start and name < start[0]:
                continue
            if info.type == FileType.Directory:
                yield from below(info.path, start[1:] if start and name == start[0] else ())
            elif info.type == FileType.File and not (start and name == start[0]):
                yield info

    found = []
    for info in below(root, after):
        if len(found) == limit:
            return found, found[-1][0]
        found.append((info.path[len(root) :].strip("/"), info.size, info.mtime))
    return found, None


@dataclass
class Prefix(InputPartition):
    root: str
    name: str
    #: Files that lie beside the prefixes rather than below one.
    lone: bool = False


class ListingReader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("a listing needs a path")
        self.path, self.limit = options["path"], int(options.get("pagekeys", PAGE_KEYS))
        if self.limit < 1:
            raise ValueError("a page has one key at least")

    def _store(self):
        from pyarrow.fs import FileSystem

        path = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        fs, root = FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
        return fs, root.rstrip("/")

    def partitions(self) -> list[Prefix]:
        """The folders right below the path, and one for the files beside them: one request's worth of names, whatever lies below."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._store()
        names = sorted(i.base_name for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if i.type == FileType.Directory)
        return [Prefix(root, n) for n in names] + [Prefix(root, "", True)]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        fs, _ = self._store()
        kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.int32())

        def batch(rows: list[tuple], page: int) -> pa.RecordBatch:
            start = f"{partition.name}/" if partition.name else ""
            cols = [[start + r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [partition.name] * len(rows), [page] * len(rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in LISTED.split(", ")])

        if partition.lone:
            own = sorted((i for i in fs.get_file_info(FileSelector(partition.root, allow_not_found=True)) if i.type == FileType.File), key=lambda i: i.base_name)
            for page, at in enumerate(range(0, len(own), self.limit)):
                yield batch([(i.base_name, i.size, i.mtime) for i in own[at : at + self.limit]], page)
            return
        token, page = None, 0
        while page == 0 or token is not None:
            rows, token = page_of(fs, f"{partition.root}/{partition.name}", token, self.limit)
            if rows:
                yield batch(rows, page)
            page += 1


class ListingSource(DataSource):
    """spark.read.format("listing"): key, size, modified, prefix and page of all files below a path; option pageKeys."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def listed(spark: SparkSession, path: str, page_keys: int = PAGE_KEYS) -> DataFrame:
    """All files below a path of any store that Arrow's file systems open, one task a prefix."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").option("pageKeys", page_keys).load(path)
