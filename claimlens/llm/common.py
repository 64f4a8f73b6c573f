"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bytes of text that one numpy pass handles at most, unless a single text is longer.
SLICE_BYTES = 3_000_000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    for field in schema.fields:
        field.nullable = True
    out = spark.read.schema(schema).parquet(path)
    out._claimlens_path = path  # noqa: SLF001
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; for tables that no later step reads."""
    path = getattr(df, "_claimlens_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)  # noqa: SLF001


def body(text: str | Column = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def text_key() -> Column:
    """A 64-bit key of a row's text, never null: for decisions that follow from the text alone."""
    return F.xxhash64("text")


def remainder(mod: int, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % mod


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` (binary) holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def keep_rows(docs: DataFrame, decide: Callable[[], Callable[[str], bool]], text: str = "text") -> DataFrame:
    """The rows whose text (null: empty) passes a test, decided where they are read: nothing is shuffled or joined.

    ``decide`` makes the test, once a task.
    """
    rows = docs.withColumn(text, F.col(text).cast("binary"))
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = decide()
        for batch in slices(batches, text):
            yield batch.filter(pa.array([good((t.as_py() or b"").decode(errors="replace")) for t in batch.column(at)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).withColumn(text, F.col(text).cast("string"))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and its n + 1 offsets."""
    big = pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def sample_ids(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """min(n, all) distinct values of ``key``: those with the smallest hashes, the same whatever repeats or their order.

    The hashes are cut at well over n distinct keys before anything is sorted or shuffled, by an estimate of their number
    that repeated rows do not move, so what moves does not grow with the rows.
    """
    ids = rows.select(key).filter(F.col(key).isNotNull())
    total = ids.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    wanted, rank = 1.5 * n + 200, F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 2 * wanted:
        ids = ids.filter(rank < int((1 << 40) * wanted / total))
    return ids.distinct().orderBy(rank, key).limit(n)


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


#: True for the six bytes that separate words: space and 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_POWERS = np.full(1 << 12, _BASE, np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)


def _powers(n: int) -> np.ndarray:
    """Powers of the base for places 0..n - 1; a table for a giant word is not kept."""
    if n <= len(_POWERS):
        return _POWERS
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of each text, in order, and each text's n + 1 word offsets.

    Words are maximal runs of bytes other than space and 9-13; a word never crosses two texts. A word's hash is a
    polynomial in its bytes, summed for all words at once, so no Python code runs per word.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begin[cuts] = inside[cuts]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    spans = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, spans)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64)
    place[~inside[starts[0] :]] = 0
    terms = _BYTE[LOWER[raw[starts[0] :]]] * _powers(int(lengths.max()))[place]
    terms[~inside[starts[0] :]] = 0
    h = mix(np.add.reduceat(terms, starts - starts[0]) + lengths.astype(np.uint64))
    return h, np.searchsorted(starts, offsets, side="left")
