"""Line deduplication over levelled sorted runs of line hashes.

A run holds (hash, n_docs, max_doc, is_new) in buckets of the hash, sorted in each. A new batch of documents is merged with
the older runs, bucket by bucket and without moving them: an anti-join tells the hashes that no older run has (an outer
merge whose unmatched rows are its result, so that all rows stay, marked), and the batch is added as a run of level 0. When a level holds ``fanout`` runs they are compacted into one
run of the next level (counts add up, the largest document id wins).

The marks decide what is looked up at the end: a hash that came up again has a row that is not new, and only such hashes
are added up over the runs; all others, nearly all, are judged by their one row where it lies.

Defined results: a null or empty text is one empty line. A repeated doc_id counts as one document for a line; each of its
rows is returned, by its own text. A null doc_id is a document of its own that never is the largest. Extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import ASCII_UPPER, forget, materialize, shared_dir, text_key

STRIP = "\t\n\x0b\x0c\r "
#: Lines found in more documents than this are joined by broadcast: at most (all occurrences / HOT) hashes, see apply().
HOT = 2_000
#: Rows of the hot side that may be broadcast; beyond it the hot bound is raised, so that fewer lines are hot.
HOT_ROWS = 100_000
#: Occurrences for each bucket of the runs, 33 bytes each, until there are as many buckets as a table may have.
BUCKET_ROWS, MAX_BUCKETS = 500_000, 100_000


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(STRIP)), ASCII_UPPER, ASCII_UPPER.lower())


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line_key(line).cast("binary")))


def is_long(line: Column, min_chars: int) -> Column:
    return F.length(F.btrim(line, F.lit(STRIP))) >= min_chars


def occurrences(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(batch, hash, at, doc_id, text_key), one row per long line; no text leaves the scan."""
    places = F.transform(lines_of(), lambda x, i: F.when(is_long(x, min_chars), F.struct(line_hash(x).alias("hash"), i.alias("at"))))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    rows = docs.select("doc_id", text_key().alias("text_key"), F.array_compact(places).alias("h"))
    return rows.select(batch.alias("batch"), F.inline("h"), "doc_id", "text_key")


class LineRuns:
    """The levelled runs. ``levels[k]`` lists the runs of level k, oldest first."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: dict[int, tuple[str, str]] = {}

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _store(self, run: DataFrame, level: int) -> DataFrame:
        """The run, dealt into buckets by its caller, as a table of sorted buckets, one file each, in the shared folder."""
        name = f"claimlens_line_run_{level}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/claimlens/{name}"
        run.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._claimlens_path = path  # noqa: SLF001
        self._tables[id(out)] = (name, path)
        return out

    def _drop(self, run: DataFrame) -> None:
        forget(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(id(run))[0]}")

    def close(self) -> None:
        """Forget all runs; no later plan may read them."""
        for run in self.runs():
            self._drop(run)
        self.levels = [[]]

    def add(self, occ: DataFrame) -> DataFrame:
        """Add one batch of (hash, doc_id); returns its run, where ``is_new`` marks the hashes that no older run has."""
        run = occ.groupBy("hash").agg(F.countDistinct(F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        run = run.repartition(self.buckets, "hash")
        found = []
        for k, old in enumerate(self.runs()):  # merges sorted buckets: only the batch moves, once
            run = run.join(old.select("hash", F.lit(True).alias(f"in_{k}")).hint("merge"), "hash", "left")
            found.append(F.col(f"in_{k}").isNull())
        is_new = reduce(Column.__and__, found, F.lit(True))  # what an anti-join with all runs leaves
        run = run.select("hash", "n_docs", "max_doc", is_new.alias("is_new"))
        stored = self._store(run, 0)
        self.levels[0].append(stored)
        self._compact()
        return stored

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                old, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._store(self._merged(old), k + 1))
                for r in old:
                    self._drop(r)

    def _together(self, parts: list[DataFrame]) -> DataFrame:
        """Rows of several runs, dealt anew by hash.

        A union of bucketed tables counts as bucketed for the planner although it only strings the buckets of its parts
        together, so that a sum over it would stay in parts. A hash that is computed anew makes it forget the buckets.
        """
        fresh = [p.withColumn("hash", F.substring("hash", 1, 2**30)) for p in parts]
        out = fresh[0]
        for part in fresh[1:]:
            out = out.unionByName(part)
        return out.repartition(self.buckets, "hash")

    def _merged(self, parts: list[DataFrame]) -> DataFrame:
        return self._together(parts).groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.max("is_new").alias("is_new"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(hash, n_docs, max_doc) of the hashes of at least ``min_docs`` documents."""
        runs, enough, columns = self.runs(), F.col("n_docs") >= min_docs, ["hash", "n_docs", "max_doc"]
        if len(runs) == 1:
            return runs[0].filter(enough).select(columns)
        again = materialize(self._together([r.filter("not is_new").select("hash") for r in runs]).distinct(), "line-again")
        out = self._merged([r.join(again, "hash", "left_semi") for r in runs]).filter(enough).select(columns)
        for r in runs:
            out = out.unionByName(r.filter(enough).join(again, "hash", "left_anti").select(columns))
        return out


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets of the runs for so many occurrences: by their number, as each bucket is a file to write and a task to merge.

    Every file costs its writer a process or two on file systems that set rights by a command. Where the session does not let shuffles be sized by their data, its own number of partitions holds.
    """
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true":
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)))


def dropped_lines(occ: DataFrame, frequent: DataFrame) -> DataFrame:
    """(drop_id, drop_key, drops): the places of the lines that each document row loses.

    A hash held by over ``bound`` documents is hot; there are at most (occurrences / bound) of them, so that side is
    broadcast. Any other hash has at most ``bound`` documents, so no key of the shuffled join is large.
    """
    bound = HOT
    while (n_hot := frequent.filter(F.col("n_docs") > bound).count()) > HOT_ROWS:
        bound *= 4
    losing = F.col("doc_id").isNull() | (F.col("doc_id") != F.col("max_doc"))
    occ = occ.select("hash", "at", "doc_id", "text_key")
    lost = occ.join(frequent.filter(F.col("n_docs") <= bound).hint("shuffle_hash"), "hash").filter(losing).drop("hash")
    if n_hot:
        lost = lost.unionByName(occ.join(F.broadcast(frequent.filter(F.col("n_docs") > bound)), "hash").filter(losing).drop("hash"))
    return lost.groupBy(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")).agg(F.collect_set("at").alias("drops"))


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept lines joined by newline), n_lines, n_dropped: one row per input row.

    Lines whose key has ``min_chars`` code points and occurs in ``min_docs`` documents stay only in the largest doc_id
    that holds them. Columns named in ``carry`` stay on their rows, the text as it was as ``before``.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", *carry)
    # sorted by batch in each file, so a batch reads its own pages of few files
    occ = materialize(occurrences(docs, min_chars, batches).sortWithinPartitions("batch"), "line-occurrences")
    runs = LineRuns(spark, fanout, bucket_count(spark, occ.count()))
    for k in range(batches):
        runs.add(occ.filter(F.col("batch") == k))
    frequent = materialize(runs.frequent(min_docs), "line-frequent")
    runs.close()
    drops = dropped_lines(occ, frequent)
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (text_key() == F.col("drop_key")), "left")

    def keep(ls: Column) -> Column:
        # by sets of places, so that a long text costs no more than its lines
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drops"))
        return F.struct(F.size(ls).cast("long").alias("n"), F.when(F.col("drops").isNull(), ls).otherwise(F.transform(left, lambda i: ls[i])).alias("kept"))

    names = ["before", *carry] if carry else []
    carried = [F.col("text").alias("before"), *carry] if carry else []
    out = joined.select("doc_id", *carried, let(lines_of(), keep).alias("l"))
    return out.select("doc_id", *names, F.array_join("l.kept", "\n").alias("text"), F.col("l.n").alias("n_lines"), (F.col("l.n") - F.size("l.kept")).alias("n_dropped"))
