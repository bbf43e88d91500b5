"""A data source that lists trees <root>/<year>/<slug>/..., with filters on years and collections pushed down.

Spark's own listing walks everything and hides names that begin with an underscore or a dot. This one lists the years and
collections that a query asks for, deals collections to tasks, and does not enter junk folders; content is never read.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from fixity_spark.functions.paths import JUNK_DIRS, JUNK_SUFFIX, visible
from fixity_spark.operators.diff import drop_self_entry
from fixity_spark.schema import INVENTORY

#: Collections that a task lists one after the other.
PER_TASK = 64
_ROWS = 10_000


class _Folders(InputPartition):
    """Collections to list: (year, slug) each."""

    def __init__(self, folders: list[tuple[int, str]]):
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.location, self.junk = options["path"].rstrip("/"), options["location"], options.get("junk") == "true"
        self.wanted: list[Filter] = []

    def _open(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            uri = self.path if "://" in self.path else self.path.replace("file:", "file://", 1)
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), self.path

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on year and slug, by which folders are chosen; Spark applies all others."""
        for f in filters:
            known = isinstance(f, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith))
            if known and f.attribute in (("year",), ("slug",)):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, column: str, value) -> bool:
        for f in self.wanted:
            if f.attribute != (column,):
                continue
            other = f.value
            if isinstance(f, In):
                ok = value in other
            elif other is None:
                ok = False
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                ok = value == other
            elif isinstance(f, GreaterThan):
                ok = value > other
            elif isinstance(f, GreaterThanOrEqual):
                ok = value >= other
            elif isinstance(f, LessThan):
                ok = value < other
            elif isinstance(f, LessThanOrEqual):
                ok = value <= other
            else:
                ok = value.startswith(other)
            if not ok:
                return False
        return True

    def _folders(self, fs, path: str) -> list[str]:
        from pyarrow import fs as afs

        return sorted(i.base_name for i in fs.get_file_info(afs.FileSelector(path)) if i.type == afs.FileType.Directory)

    def partitions(self) -> list[InputPartition]:
        fs, root = self._open()
        years = [y for y in self._folders(fs, root) if len(y) == 4 and y.isascii() and y.isdigit() and self._keeps("year", int(y))]
        found = [(int(y), s) for y in years for s in self._folders(fs, f"{root}/{y}") if self._keeps("slug", s)]
        return [_Folders(found[k : k + PER_TASK]) for k in range(0, len(found), PER_TASK)] or [_Folders([])]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, root = self._open()
        rows: list[tuple] = []
        for year, slug in partition.folders:
            top = f"{root}/{year}/{slug}"
            work = [top]
            while work:
                for i in fs.get_file_info(afs.FileSelector(work.pop(), allow_not_found=True)):
                    if i.type == afs.FileType.Directory:
                        if self.junk or not (i.base_name in JUNK_DIRS or i.base_name.endswith(JUNK_SUFFIX)):
                            work.append(i.path)
                    elif i.type == afs.FileType.File:
                        at = i.mtime if isinstance(i.mtime, datetime.datetime) else None
                        rows.append((year, slug, self.location, i.path[len(top) + 1 :], i.size, at))
                        if len(rows) == _ROWS:
                            yield self._batch(rows)
                            rows = []
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["year", "slug", "location", "rel", "size_bytes", "mtime"])


class FileTree(DataSource):
    """Options: path (a URI that pyarrow's file systems open on every machine), location, junk (true: enter junk folders)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, location: str, raw: bool = False) -> DataFrame:
    """An inventory of the tree at path, manifests left out; with raw everything is there that clean_plan (D12) looks
    for: hidden and junk files, and what is in junk folders. Names that begin with an underscore are always there, as
    D11 needs them.

    Filters on year and slug choose the folders that are listed; the tree must be reachable by this path on every
    machine. What goes while it is listed is left out.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
    rows = drop_self_entry(spark.read.format("file_tree").options(location=location, junk=str(raw).lower()).load(path))
    return rows if raw else rows.where(visible(F.col("rel")))
