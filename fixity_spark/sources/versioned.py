"""Tables of keyed rows that several writers change: manifests and counters with commits, snapshots and conflicts.

A table is a folder: data/<run> holds rows as Parquet, commits/<number>.json names, in order, the runs that count. A
commit is a file that is put in place by one rename, which fails if that number is taken: of two writers that read the
same version one is refused and looks again. Rows without a commit are not part of any version, so a writer that dies
between the two leaves the table as it was. Nothing is rewritten by a merge: of rows with one key, the newest commit holds.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixity_spark.scratch import drop, folders, get_dealt, put_dealt, shuffle_buckets


class Refused(RuntimeError):
    """Another writer committed first what this one would have."""


class VersionedTable:
    """A table of rows with a key.

    partitions name columns that tell apart what writers change, such as the year: merges that touch different values
    of them do not refuse each other. version 0 is the empty table. dealt, columns of the key, is for large tables: rows lie
    dealt by them, so that those of one key, in whatever runs, are read where they are. Runs that writers with other
    numbers of shuffle partitions dealt are shuffled.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: list[str], partitions: list[str] | None = None, dealt: list[str] | None = None):
        self.spark, self.path, self.key, self.partitions, self.dealt = spark, path, key, partitions or [], dealt or []
        if not set(self.dealt) <= set(key):
            raise ValueError("rows are dealt by columns of their key")
        self._how: dict[str, dict | None] = {}
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.makeQualified(hadoop.Path(path)).toUri(), conf)
        kind = getattr(hadoop, "Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(kind, 1)
        self._no_overwrite[0] = kind.valueOf("NONE")

    def _names(self, folder: str) -> list[str]:
        return folders(self.spark, f"{self.path}/{folder}")

    def _commits(self, as_of: int | None = None, since: int | None = None) -> list[dict]:
        """The commits up to a version, in order: those after since, or, without it, from the newest whole version that is
        marked, as nothing before it is needed."""
        upto = [int(n[:-5]) for n in self._names("commits") if n.endswith(".json")]
        upto = [v for v in upto if as_of is None or v <= as_of]
        first = since + 1 if since is not None else max((int(n) for n in self._names("whole") if n.isdigit() and int(n) in upto), default=0)
        paths = [f"{self.path}/commits/{v:020d}.json" for v in upto if v >= first]
        if not paths:
            return []
        texts = self.spark.read.text(paths, wholetext=True)
        return sorted((json.loads(r.value) for r in texts.collect()), key=lambda c: c["version"])  # one small file each

    def version(self) -> int:
        """The number of the newest commit."""
        return max((int(n[:-5]) for n in self._names("commits") if n.endswith(".json")), default=0)

    def read(self, as_of: int | None = None) -> DataFrame:
        """The rows of a version, each key once; a row that was deleted is not there."""
        commits = self._commits(as_of)
        start = max((k for k, c in enumerate(commits) if c["whole"]), default=0)  # what was before a whole version is in it
        runs = commits[start:]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        numbers = F.create_map(*[F.lit(x) for c in runs for x in (c["run"], c["version"])])
        rest = [f.name for f in self.schema.fields if f.name not in self.key]
        newest = self._rows(runs).groupBy(*self.key).agg(F.max_by(F.struct(*rest, "_gone"), numbers[F.col("_run")]).alias("_r"))
        return newest.where(~F.col("_r._gone")).select(*[F.col(n) if n in self.key else F.col("_r")[n].alias(n) for n in self.schema.names])

    def _rows(self, commits: list[dict]) -> DataFrame:
        """The rows of the runs of some commits, with _gone and _run."""
        fields = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_run", T.StringType())])
        folder = lambda c: f"{self.path}/data/{c['run']}"
        if len(commits) <= MOST_SCANS and all(c.get("dealt") for c in commits):
            # nothing that renames or computes columns below the union, so that it is known to lie dealt as they do; the
            # condition, which all rows meet, makes it one of rows: a union of column batches does not bring buckets together
            return reduce(DataFrame.unionByName, [get_dealt(self.spark, folder(c), fields, **c["dealt"]).where("_gone IS NOT NULL") for c in commits])
        return self.spark.read.schema(fields).parquet(*map(folder, commits))

    def _write(self, rows: DataFrame, gone: bool = False) -> tuple[str, list | None]:
        """Rows written without being part of the table yet: the run, and the partitions they touch."""
        run = uuid.uuid4().hex
        out = f"{self.path}/data/{run}"
        said = [c for c in rows.columns if c in (self.key if gone else self.schema.names)]  # a key alone tells that it is gone
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in said else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        # rows that lie dealt stay where they are: neither looking for keys given twice nor writing needs a shuffle then
        by = Window.partitionBy(*(self.dealt or self.key)).orderBy(*self.key)
        key = F.struct(*self.key)
        put = rows.select(*columns, F.lit(gone).alias("_gone"), F.lit(run).alias("_run")).withColumn("_twice", key.eqNullSafe(F.lag(key).over(by)))
        self._how[run] = {"by": self.dealt, "buckets": shuffle_buckets(self.spark)} if self.dealt else None
        if self.dealt:
            put_dealt(put, out, **self._how[run])
        else:
            put.write.parquet(out)
        if not self.spark.read.schema("_twice boolean").parquet(out).where("_twice").isEmpty():
            drop(self.spark, out)
            raise ValueError("a key is given twice")
        touched = None
        if self.partitions:
            values = self.spark.read.schema(self.schema).parquet(out).select(*self.partitions).distinct().limit(MOST_PARTITIONS + 1).collect()
            touched = sorted(map(list, values), key=str) if len(values) <= MOST_PARTITIONS else None
        return run, touched

    def _commit(self, version: int, run: str, touched: list | None, whole: bool = False) -> None:
        text = json.dumps({"version": version, "run": run, "touched": touched, "whole": whole, "dealt": self._how.get(run)})
        staged, final = self._path(f"{self.path}/staged/{run}.json"), self._path(f"{self.path}/commits/{version:020d}.json")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(staged, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), self._no_overwrite)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                self._fs.delete(staged, False)
                raise Refused(f"version {version} of {self.path} is taken") from None
            raise

    def merge(self, rows: DataFrame, gone: bool = False, tries: int = 20) -> int:
        """Adds rows, or, with gone, takes out their keys; the version that holds them.

        Rows are written once. Where other writers committed meanwhile, the next number is tried: merges say what a key
        is from now on, so they may follow each other in any order.
        """
        run, touched = self._write(rows, gone)
        for _ in range(tries):
            version = self.version() + 1
            try:
                self._commit(version, run, touched)
                return version
            except Refused:
                continue
        raise Refused(f"{tries} other commits came first")

    def replace(self, read_version: int, rows: DataFrame) -> int:
        """Adds rows that were made from what version read_version holds; refused if a commit after it touched one of
        their partitions, or any commit came where the table has none."""
        run, touched = self._write(rows)
        while True:
            since = self._commits(since=read_version)
            if any(c["whole"] is False and (touched is None or c["touched"] is None or any(t in c["touched"] for t in touched)) for c in since):
                raise Refused(f"{self.path} changed after version {read_version}")
            try:
                version = max([read_version, *(c["version"] for c in since)]) + 1
                self._commit(version, run, touched)
                return version
            except Refused:
                continue  # whoever took the number may have changed something else

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Adds change(rows) made from the newest version, again and again until no other writer came between."""
        for _ in range(tries):
            now = self.version()
            try:
                return self.replace(now, change(self.read(now)))
            except Refused:
                continue
        raise Refused(f"{tries} other commits came first")

    def compact(self) -> int:
        """Writes the newest version as one run; older versions stay readable, and writers do not mind."""
        now = self.version()
        run, touched = self._write(self.read(now))
        self._commit(now + 1, run, touched, whole=True)
        self._fs.mkdirs(self._path(f"{self.path}/whole/{now + 1}"))  # only saves reading commits; it may be missing
        return now + 1

    def sweep(self, older_than_s: float = 24 * 3600.0, keep_from: int | None = None) -> int:
        """Removes runs that no commit names, left by writers that died or were refused, if nothing was put to them for so
        many seconds; the number of runs removed.

        A writer that takes longer from its last row to its commit would lose its run, so the time must exceed that. With
        keep_from, runs that only versions before it need go, too: reading such a version fails from then on.
        """
        if keep_from is not None and not 0 < keep_from <= self.version():
            raise ValueError(f"there is no version {keep_from}")
        held = [n for n in self._names("data") if self._idle(f"{self.path}/data/{n}") >= older_than_s]
        commits = self._commits(since=0)  # after the runs, so that a run committed meanwhile is named
        start = 0 if keep_from is None else max((c["version"] for c in commits if c["whole"] and c["version"] <= keep_from), default=0)
        named = {c["run"] for c in commits if c["version"] >= start}
        gone = [n for n in held if n not in named]
        for n in gone:
            drop(self.spark, f"{self.path}/data/{n}")
        for n in self._names("staged"):
            if self._idle(f"{self.path}/staged/{n}") >= older_than_s:
                drop(self.spark, f"{self.path}/staged/{n}")
        return len(gone)

    def _idle(self, path: str) -> float:
        """Seconds since the newest change in a folder, or of a file."""
        found = self._fs.getFileStatus(self._path(path))
        below = self._fs.listStatus(found.getPath()) if found.isDirectory() else []
        return time.time() - max(s.getModificationTime() for s in (found, *below)) / 1000


#: Partitions that a commit lists; one that touches more counts as touching all.
MOST_PARTITIONS = 1000
#: Dealt runs that are read each by itself; of more, all are read at once and shuffled, until the table is compacted.
MOST_SCANS = 64
