"""Stored tables that an interrupted write neither loses nor half-changes.

Two ways to change a table folder:

* :func:`swap` exchanges one whole table: the old one is renamed aside and
  deleted only when the new one is in place.
* :class:`Load` changes several tables at once, whole or by single partitions.
  Everything new is first written to a staging folder; then one small intent
  file is renamed into place; then the changes it lists are carried out.
  Before the intent exists nothing stored has changed; from then on every step
  can be repeated, so :func:`recover` finishes the load.  Partitions that a
  load does not list keep their files.

:func:`recover` runs before any read or write of the tables of a base folder.
All paths are on the cluster's file system; nothing but file names passes
through the driver.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..session import setting, shuffles_end_with_actions

STAGING = "_staging"
INTENT = "_intent.json"
STALE = "_stale_partitions.json"

#: stored tables are written once and read often: smaller files for some CPU time
CODEC = "zstd"

#: files a task writes side by side before it sorts its rows by partition
OPEN_FILES = 8


class Files:
    """The few file-system operations that writes need, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path(os.path.join(*parts))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        at = self._path(path)
        if self.fs.exists(at) and not self.fs.delete(at, True):
            raise OSError(f"cannot delete {path}")

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written under another name first."""
        out = self.fs.create(self._path(f"{path}.new"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.delete(path)
        self.rename(f"{path}.new", path)


# ---- one whole table -----------------------------------------------------------------
def restore(spark: SparkSession, final: str, files: Files | None = None) -> None:
    """Undo or finish an interrupted :func:`swap`: a table set aside comes back when no new one took its place."""
    files = files or Files(spark, final)
    old = f"{final}__old"
    if files.exists(old):
        if files.exists(final):
            files.delete(old)
        else:
            files.rename(old, final)


def swap(spark: SparkSession, staging: str, final: str, files: Files | None = None) -> None:
    """Put a completely written table in place of the old one.

    After a crash at any point the table or the one set aside is whole, and
    :func:`restore`, which every read and write begins with, gives it its name back.
    """
    files = files or Files(spark, final)
    restore(spark, final, files)
    old = f"{final}__old"
    if files.exists(final):
        files.rename(final, old)
    files.rename(staging, final)
    if files.exists(final):  # seen in place
        files.delete(old)


# ---- several tables, whole or by partition ----------------------------------------------
def recover(spark: SparkSession, base: str, files: Files | None = None) -> None:
    """Bring the tables of a base folder into a whole state: finish a load whose intent is written,
    bring back tables set aside by an interrupted swap."""
    files = files or Files(spark, base)
    for name in files.names(base):
        if name.endswith("__old"):
            restore(spark, os.path.join(base, name[:-len("__old")]), files)
    intent = os.path.join(base, INTENT)
    if files.exists(intent):
        _carry_out(files, base, json.loads(files.read(intent)))


def _carry_out(files: Files, base: str, intent: dict) -> None:
    """Do what an intent lists; every step may already have been done."""
    for target in intent["replace"]:  # a table or one of its partitions, whole in the staging folder
        new, at = os.path.join(base, STAGING, target), os.path.join(base, target)
        if files.exists(new):
            files.delete(at)
            files.mkdirs(os.path.dirname(at))
            files.rename(new, at)
    for target in intent["remove"]:
        files.delete(os.path.join(base, target))
    stale = os.path.join(base, STALE)
    if intent["stale"] or intent["fresh"]:
        now = set(json.loads(files.read(stale))) if files.exists(stale) else set()
        files.write(stale, json.dumps(sorted((now | set(intent["stale"])) - set(intent["fresh"]))))
    files.delete(os.path.join(base, INTENT))
    files.delete(os.path.join(base, STAGING))


def stale_partitions(spark: SparkSession, base: str) -> set[str]:
    """Partitions whose derived tables are older than the load that changed them."""
    files = Files(spark, base)
    path = os.path.join(base, STALE)
    return set(json.loads(files.read(path))) if files.exists(path) else set()


class Load:
    """A change of stored tables under ``base`` that happens wholly or not at all.

    ``stage_*`` write the new contents aside; ``commit`` puts them in place.
    One load at a time: a second one would recover, and so finish, the first.
    """

    def __init__(self, spark: SparkSession, base: str, files: Files | None = None):
        self.spark, self.base = spark, base
        self.files = files or Files(spark, base)
        recover(spark, base, self.files)
        self.files.delete(os.path.join(base, STAGING))
        self.intent: dict[str, list] = {"replace": [], "remove": [], "stale": [], "fresh": []}
        self.touched: dict[str, set[str]] = {}  # partitions staged so far, by table

    def stage_table(self, name: str, df: DataFrame, partition: str | None = None, placed: bool = False) -> None:
        """The whole table anew; ``placed`` as for :meth:`stage_partitions`."""
        self._write(df, name, partition, placed)
        self.intent["replace"].append(name)

    def stage_partitions(self, name: str, df: DataFrame, column: str, touched: list, placed: bool = False) -> None:
        """``df`` becomes the content of the ``touched`` partitions; those it has no rows for go.

        ``placed`` says that few partitions meet in a task already, as in rows
        read from stored partitions: they are written without another shuffle.
        Further calls for a table stage further partitions of it.

        A row outside the touched partitions is an error, found before anything stored changes.
        """
        if not touched:
            return
        before = self.touched.setdefault(name, set())
        self._write(df, name, column, placed, "append" if before else "overwrite")
        allowed = {f"{column}={v}" for v in touched}
        found = {d for d in self.files.names(self.place(name)) if "=" in d} - before
        if found - allowed:
            raise ValueError(f"{name}: rows outside the partitions to replace: {sorted(found - allowed)}")
        before |= allowed
        self.intent["replace"] += [f"{name}/{d}" for d in sorted(found)]
        self.intent["remove"] += [f"{name}/{d}" for d in sorted(allowed - found)]

    def mark(self, stale: list[str] = (), fresh: list[str] = ()) -> None:
        """Remember with the commit which partitions derived tables must follow, or have followed."""
        self.intent["stale"] += list(stale)
        self.intent["fresh"] += list(fresh)

    def place(self, name: str) -> str:
        """Where a table's new content is staged."""
        return os.path.join(self.base, STAGING, name)

    def _write(self, df: DataFrame, name: str, partition: str | None, placed: bool = False, mode: str = "overwrite") -> None:
        path = self.place(name)
        if not partition:
            with shuffles_end_with_actions(self.spark):
                df.write.mode(mode).option("compression", CODEC).parquet(path)
            return
        # rows of a partition meet in few tasks, so it is few files; the
        # rebalance splits one too large for a task
        rows = df if placed else df.hint("rebalance", partition)
        with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)), shuffles_end_with_actions(self.spark):
            rows.write.mode(mode).option("compression", CODEC).partitionBy(partition).parquet(path)

    def commit(self) -> None:
        if any(self.intent.values()):
            self.files.mkdirs(self.base)
            self.files.write(os.path.join(self.base, INTENT), json.dumps(self.intent))
            _carry_out(self.files, self.base, self.intent)
