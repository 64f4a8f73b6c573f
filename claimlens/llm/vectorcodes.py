"""Vector codes: each vector is cut into parts, and each part is replaced by the index of its nearest codebook entry.

A part position's codebook starts as that part of the vectors with the smallest ids and is refined by rounds of assignment and
averaging, all in integers. The nearest entry is found by segment-mean lower bounds. For a block of b components with
means u, v and residual norms r, s (the norms of what the means leave), the squared distance is at least
b (u - v)^2 + (r - s)^2. Summed over blocks this bounds the distance from below; coarse blocks (the whole part) come first, then
halves, down to blocks of two or three. An entry goes as soon as a bound is beyond the exact distance to the entry with
the least coarse bound; those that survive all levels get exact integer distances, so the result is that of a full search.

Each round is one pass over all vectors: a task sums its own parts by (position, entry), and only these sums, at most
64 x dimension rows a task, are shuffled and come to the driver. Codebooks have that size whatever the data.

Defined results: vectors that are null or hold null or non-finite components are left out. Vectors are taken as if padded with
zeros to the longest one's length, rounded up to a multiple of the number of parts. A null id comes last; equal ids are ordered by
their vectors; repeated rows count each. With fewer vectors than entries a codebook has as many entries as there are
vectors. Components beyond +-16,384 raise an error, as their sums may not fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import integers, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that one numpy pass handles at most.
ROWS = 4096


def block_edges(width: int) -> list[np.ndarray]:
    """The starts of the blocks of each level: the whole part, halves, and so on while blocks have two components."""
    out, n = [], 1
    while n == 1 or width // n >= 2:
        out.append(np.unique(np.linspace(0, width, n + 1).astype(np.int64)[:-1]))
        n *= 2
    return out


def _summary(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's blocks: sqrt(b) times the mean, and the residual norm; from exact integer sums."""
    b = np.diff(np.append(edges, x.shape[1]))
    total, square = np.add.reduceat(x, edges, axis=1), np.add.reduceat(x * x, edges, axis=1)
    return total / np.sqrt(b), np.sqrt((b * square - total * total) / b)


class Codebook:
    """The entries of one part position, with their block summaries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.edges = block_edges(entries.shape[1]) if entries.shape[1] else []
        self.levels = [_summary(entries, e) for e in self.edges]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's nearest entry (ties: the lowest) and the exact squared distance."""
        n = len(x)
        if not n or not self.levels:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        mean, norm = _summary(x, self.edges[0])
        bound = (mean - self.levels[0][0].T) ** 2 + (norm - self.levels[0][1].T) ** 2
        guess = self.entries[bound.argmin(axis=1)]
        most = ((x - guess) ** 2).sum(axis=1)
        most = most + 1e-6 * (1 + most)  # bounds are floats: their error stays far below this
        row, entry = np.nonzero(bound <= most[:, None])
        for edges, (means, norms) in zip(self.edges[1:], self.levels[1:], strict=True):
            mean, norm = _summary(x, edges)
            bound = ((mean[row] - means[entry]) ** 2 + (norm[row] - norms[entry]) ** 2).sum(axis=1)
            kept = bound <= most[row]
            row, entry = row[kept], entry[kept]
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1) * ENTRIES + entry
        least = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(n)))
        return least % ENTRIES, least // ENTRIES


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _sums(vectors: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """(part, entry, pos, total, n) of the parts of all vectors (column vec), summed by their nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books[0].entries)
        total, count = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in _chunks(batches):
            x = integers(batch.column(0), PARTS * width)
            for p, book in enumerate(books):
                part = x[:, p * width : (p + 1) * width]
                entry, _ = book.nearest(part)
                np.add.at(total[p], entry, part)
                count[p] += np.bincount(entry, minlength=k)
        part, entry, pos = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
        columns = [part, entry, pos, total[part, entry, pos], count[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "pos", "total", "n"])

    return vectors.mapInArrow(run, "part long, entry long, pos long, total long, n long").groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(vectors: DataFrame) -> list[Codebook]:
    """The codebooks of all part positions, from (vec_id, vec), all of them usable."""
    width = -(-(vectors.agg(F.max(F.size("vec"))).first()[0] or 0) // PARTS)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").toArrow()
    start = integers(first.column(0).combine_chunks(), PARTS * width) if first.num_rows else np.zeros((0, PARTS * width), np.int64)
    books = [Codebook(start[:, p * width : (p + 1) * width]) for p in range(PARTS)]
    for _ in range(ROUNDS if start.size else 0):
        entries = [book.entries.copy() for book in books]
        for part, entry, pos, total, n in _sums(vectors.select("vec"), books, width).collect():
            entries[part][entry, pos] = total // n
        books = [Codebook(e) for e in entries]
    return books


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.entries.reshape(-1).tolist()).encode()).hexdigest()


def encode(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error (over equal labels, nulls together), codebooks_sha256."""
    vectors = rows.filter(usable(F.col(vec))).select("vec_id", "label", F.col(vec).alias("vec"))
    books = fit(vectors)
    width = books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            x = integers(batch.column(2), PARTS * width)
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                entry, far = book.nearest(x[:, p * width : (p + 1) * width])
                codes[:, p] = entry
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    coded = materialize(vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("l_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("l_label"))).drop("l_label")
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))
