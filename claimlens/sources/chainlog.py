"""The evidence log as a table that is appended to: commits are atomic, can be retried, and leave one unbroken chain.

An append writes its entries to a folder of its own and then publishes a manifest under the next version number, which
succeeds for one writer only. A writer that loses starts over from the heads that the winner left, so seq and prev never repeat.
Readers see the folders that manifests name: what a writer left that died, or lost, is no part of the log. An append with a
token is done at most once, however often it is tried.

Each commit also writes the heads (last seq and hash) of its studies, so an append reads no entries. A chain is sequential: the entries
of one study in one append are folded in order by one task, as a stream, which holds a single entry; studies run in parallel.

Publishing needs a file system with an atomic rename that does not overwrite (HDFS and the like), or a local folder.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import chain
from .shared import file_system

ENTRY = "study string, seq long, ts string, kind string, prev string, hash string, raw string"
HEAD = "study string, head_seq long, head_hash string"


class ChainLog:
    """A log of many studies below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifests(self) -> list[dict]:
        """The commits so far, in order."""
        fs, folder = file_system(self.spark, f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
        return [json.loads(self._read(f"commits/{n}")) for n in names if n.endswith(".json")]

    def entries(self) -> DataFrame:
        """study, seq, ts, kind, prev, hash, raw of all committed entries."""
        return self._table("entries", self.manifests(), ENTRY)

    def heads(self, manifests: list[dict] | None = None) -> DataFrame:
        """study, head_seq, head_hash: where each study's chain ends."""
        found = self._table("heads", self.manifests() if manifests is None else manifests, HEAD)
        return found.groupBy("study").agg(F.max("head_seq").alias("head_seq"), F.max_by("head_hash", "head_seq").alias("head_hash"))

    def append(self, rows: DataFrame, token: str | None = None, ts: str | None = None) -> int:
        """Chain rows (study, kind, payload, ord) behind what is there, each study's by ord; the version that holds them.

        payload is a JSON object; seq, ts, kind, prev and hash are the log's own, whatever it says of them. A row
        without a study, or with a payload that is no object, fails the append, and nothing of it is seen.
        """
        token = token or uuid.uuid4().hex
        ts = ts or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        while True:
            manifests = self.manifests()
            for m in manifests:
                if m["token"] == token:
                    return m["version"]
            name, version = uuid.uuid4().hex, len(manifests) + 1
            chain(rows, self.heads(manifests), ts).write.parquet(f"{self.path}/entries/{name}")
            ends = self._table("entries", [{"name": name}], ENTRY).groupBy("study").agg(F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"))
            ends.write.parquet(f"{self.path}/heads/{name}")
            if self._publish(version, {"version": version, "token": token, "name": name}):
                return version
            self._delete(f"entries/{name}"), self._delete(f"heads/{name}")

    def _table(self, kind: str, manifests: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{m['name']}" for m in manifests]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _read(self, name: str) -> str:
        fs, path = file_system(self.spark, f"{self.path}/{name}")
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _delete(self, name: str) -> None:
        fs, path = file_system(self.spark, f"{self.path}/{name}")
        fs.delete(path, True)

    def _publish(self, version: int, manifest: dict) -> bool:
        """Put the whole manifest under its number unless there is one; false if another writer was first."""
        fs, draft = file_system(self.spark, f"{self.path}/drafts/{manifest['name']}.json")
        out = fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        fs, final = file_system(self.spark, f"{self.path}/commits/{version:012d}.json")
        fs.mkdirs(final.getParent())
        if str(fs.getScheme()) == "file":
            local = lambda p: Path(unquote(urlparse(str(p.toUri())).path))
            try:
                os.link(local(draft), local(final))  # atomic, and never over a file that is there
            except FileExistsError:
                return False
            finally:
                fs.delete(draft, False)
            return True
        jvm = self.spark._jvm  # noqa: SLF001
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # noqa: SLF001
        try:
            context.rename(draft, final, none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True
