"""Folder trees as tables: a data source that lists folders in parallel and reads no content, snapshots, and streamed hashes.

Paths are URIs that pyarrow opens (file, hdfs, s3, gs), or local paths that all executors see.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import HASH_LIMIT, MAX_LISTED, MAX_SNAPSHOT, MAX_WALK, SKIP_FOLDERS

#: Folders that the driver opens until it has so many to deal out, each one a partition.
FOLDERS = 64
CHUNK = 1 << 20
_TESTS = {LessThan: "__lt__", LessThanOrEqual: "__le__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__"}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    found, inner = pafs.FileSystem.from_uri(path)
    return found, inner.rstrip("/") or "/"


class Subtree(InputPartition):
    """A folder (relative to the root) to list: its files alone, or all below it."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skipped: list[str]):
        self.root, self.skipped, self.tests = root, frozenset(skipped), []

    def _list(self, folder: str) -> tuple[list[pafs.FileInfo], list[str]]:
        """The files of a folder, and the names of its folders that are not skipped; a folder that is gone has neither."""
        found, root = _opened(self.root)
        info = found.get_file_info(pafs.FileSelector(f"{root}/{folder}" if folder else root, allow_not_found=True))
        return [i for i in info if i.type == pafs.FileType.File], sorted(i.base_name for i in info if i.type == pafs.FileType.Directory and i.base_name not in self.skipped)

    def partitions(self) -> list[InputPartition]:
        """Folders are opened breadth first; those that were opened give their own files, the others all below them."""
        todo, opened = deque([""]), []
        while todo and len(todo) + len(opened) < FOLDERS:
            folder = todo.popleft()
            opened.append(folder)
            todo.extend(f"{folder}/{name}".lstrip("/") for name in self._list(folder)[1])
        return [Subtree(f, False) for f in opened] + [Subtree(f, True) for f in todo]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            files, folders = self._list(folder)
            above = ["1" + name for name in folder.split("/") if name]
            for i in files:
                if all(getattr(i.size, test)(value) for test, value in self.tests):
                    yield f"{folder}/{i.base_name}".lstrip("/"), i.size, i.mtime_ns, [*above, "0" + i.base_name]
            if partition.deep:
                todo += [f"{folder}/{name}".lstrip("/") for name in folders]


class FilteringReader(TreeReader):
    """A reader for sessions that push filters to Python sources; in others Spark accepts none that could."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the size are applied while listing."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("size",):
                self.tests.append((_TESTS[type(f)], f.value))
            else:
                yield f


class Tree(DataSource):
    """path (below the root), size, mtime (ns) and ord of the files below a folder; ``skip`` names folders not to enter, and with
    ``push`` comparisons of the size are applied while listing (for sessions with spark.sql.python.filterPushdown.enabled).

    Sorted by ord, a folder's files come by name ahead of its folders, as a walk from the top meets them.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, mtime long, ord array<string>"

    def reader(self, schema) -> TreeReader:
        skipped = self.options.get("skip")
        kind = FilteringReader if self.options.get("push") == "true" else TreeReader
        return kind(self.options["path"], SKIP_FOLDERS if skipped is None else skipped.split(","))


def tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder, in no order."""
    spark.dataSource.register(Tree)
    return spark.read.format("tree").option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(root)


def walk(spark: SparkSession, root: str, limit: int = MAX_WALK) -> DataFrame:
    """The first files of a walk through a folder; what comes after ``limit`` files is not seen."""
    return tree(spark, root).orderBy("ord").limit(limit)


def snapshot(spark: SparkSession, root: str, limit: int = MAX_SNAPSHOT) -> DataFrame:
    """path, size, mtime, ord of the files below a folder now."""
    return walk(spark, root, limit)


def _digest(found: pafs.FileSystem, path: str, limit: int | None) -> str | None:
    """The SHA-256 of a file, read in chunks; null over the limit, or where it cannot be read."""
    try:
        if limit is not None and found.get_file_info(path).size > limit:
            return None
        digest = hashlib.sha256()
        with found.open_input_stream(path, compression=None, buffer_size=0) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
        return digest.hexdigest()
    except (OSError, TypeError):
        return None


def with_hashes(files: DataFrame, root: str, wanted: Column | None = None, limit: int | None = None) -> DataFrame:
    """``files`` (path, …) with sha256, streamed from below ``root`` by the executors; null over ``limit`` bytes or if not ``wanted``."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, top = _opened(root)
        for batch in batches:
            paths, ask = batch.column(names.index("path")).to_pylist(), batch.column(len(names)).to_pylist()
            hashes = [_digest(found, f"{top}/{p}", limit) if p is not None and a else None for p, a in zip(paths, ask, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hashes, pa.string())], names=[*names, "sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.withColumn("_wanted", F.lit(True) if wanted is None else wanted).mapInArrow(run, f"{schema}, sha256 string")


def changes(before: DataFrame, after: DataFrame, root: str) -> DataFrame:
    """What a run did to a folder, from snapshots: path, change, size, ord, listed, sha256.

    The first 500 created or modified files in the walk's order are listed: they get the hash that they have now, up to 50 MiB.
    """
    b = before.select(F.col("path").alias("_path"), F.struct("size", "mtime").alias("_old"))
    both = after.join(b, F.col("path") == F.col("_path"), "full")
    same = F.struct("size", "mtime").eqNullSafe(F.col("_old"))
    change = F.when(F.col("path").isNull(), "deleted").when(F.col("_old").isNull(), "created").when(~same, "modified")
    rows = both.select(F.coalesce("path", "_path").alias("path"), change.alias("change"), "size", "ord").filter("change is not null")
    first = rows.filter("change <> 'deleted'").orderBy("ord").limit(MAX_LISTED).select("path", F.lit(True).alias("listed"))
    listed = rows.join(F.broadcast(first), "path", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return with_hashes(listed.select("path", "change", "size", "ord", "listed"), root, F.col("listed"), HASH_LIMIT)
