"""Benchmark decontamination by pigeonhole edit matching.

A normalised item (lower case, white space collapsed) of n characters may be off by k = floor(rate * n) edits. It is split
into k + 1 pieces: any text within k edits of it holds at least one piece unchanged. An Aho-Corasick automaton over all
pieces finds these hits in whole texts; Myers' bit-parallel algorithm then gives the least edit distance between the item
and any substring around the hits.

Items are searched in slabs of at most ``slab_chars`` characters, so the automaton that travels to the executors has a
bounded size whatever the benchmark's; more items mean more passes.

Defined results: null and empty texts and items match nothing. Repeated rows each get their matches; equal items each
match. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, keep_rows

MATCH_SCHEMA = "doc_id long, item_id long, distance long, budget long, match_start long, match_end long"
SLAB_CHARS = 2_000_000


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, with their offsets."""
    n, m = len(item), min(budget + 1, len(item))
    cuts = [n * i // m for i in range(m + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to a substring of ``text``, that substring's end); the first end on ties."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j
            if not best:
                break
    return best, at


class Matcher:
    """All items of a slab; ``find`` gives the best match of each item in a normalised text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, where = [], {}
        for item_id, text in items:
            budget = math.floor(rate * len(text))
            k = len(self.items)
            self.items.append((item_id, text, budget, masks(text), masks(text[::-1])))
            for at, piece in pieces(text, budget):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        starts: dict[int, list[int]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for k, at in uses:
                starts.setdefault(k, []).append(end + 1 - length - at)
        out = []
        for k, begins in starts.items():
            item_id, item, budget, peq, rev = self.items[k]
            n = len(item)
            # windows that all alignments within the budget of a hit lie in; overlapping ones are searched once
            windows: list[list[int]] = []
            for b in sorted(set(begins)):
                lo, hi = max(0, b - budget), min(len(text), b + n + budget)
                if windows and lo <= windows[-1][1] - n:
                    windows[-1][1] = max(windows[-1][1], hi)
                else:
                    windows.append([lo, hi])
            best = None
            for lo, hi in windows:
                d, e = myers(peq, n, text[lo:hi])
                if d <= budget and (best is None or d < best[0]):
                    best = (d, lo, lo + e)
                    if not d:
                        break
            if best:
                d, lo, end = best
                _, back = myers(rev, n, text[max(0, end - n - budget) : end][::-1])
                out.append((item_id, d, budget, end - back, end))
        return sorted(out)


def benchmark_slabs(benchmark: DataFrame, slab_chars: int) -> Iterator[list[tuple[int, str]]]:
    slab, size = [], 0
    rows = benchmark.select("item_id", "text").filter("text is not null and item_id is not null")
    for item_id, text in rows.toLocalIterator():
        text = normalise(text)
        if text:
            if slab and size + len(text) > slab_chars:
                yield slab
                slab, size = [], 0
            slab.append((item_id, text))
            size += len(text)
    if slab:
        yield slab


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, slab_chars: int = SLAB_CHARS) -> DataFrame:
    """One row per document row and item found in it; match_start and match_end count in the normalised text."""
    docs = docs.select("doc_id", body().alias("body"))
    out = None
    for slab in benchmark_slabs(benchmark, slab_chars):

        def run(batches: Iterator[pa.RecordBatch], slab=slab) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(slab, rate)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows += [(doc_id, *m) for m in matcher.find(normalise(text.as_py().decode(errors="replace")))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        names = [x.split()[0] for x in MATCH_SCHEMA.split(", ")]
        found = docs.mapInArrow(run, MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCH_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, slab_chars: int = SLAB_CHARS) -> DataFrame:
    """The documents that hold no benchmark item; all columns stay."""

    def clean(slab: list[tuple[int, str]]):
        matcher = Matcher(slab, rate)
        return lambda text: not matcher.find(normalise(text))

    for slab in benchmark_slabs(benchmark, slab_chars):
        docs = keep_rows(docs, lambda slab=slab: clean(slab))
    return docs
