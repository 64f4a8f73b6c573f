"""Hard negatives by dual-tree search: for anchors and their nearest positives, the highest negatives inside a band of scores.

Scores are inner products of integer vectors. Trees stand over anchors and over candidates. A node is a ball (centre c, radius
r); for two nodes every inner product lies in c1.c2 +- (|c1| r2 + |c2| r1 + r1 r2). If that interval lies outside what
all anchors of a node still look for, the whole group of anchors is done with that node; leaf pairs are scored exactly.

The top of the candidate tree is fitted on a bounded sample (``SAMPLE`` vectors) and splits all rows into at most ``LEAVES`` leaves;
a leaf is dealt by a hash into blocks of about ``BLOCK`` rows. Inside a block, each task builds the rest of the tree over
its candidates, one tree a label, and the same over the anchors that came to it, and walks down both together. Two searches use it:

1. Positives: anchors search their own leaf first. The score of the last positive found there is a floor, so anchors go
   only to those other leaves whose interval reaches it.
2. Negatives: the positives' scores give each anchor the band low * score <= 100 * s <= high * score; anchors go to the
   leaves whose interval meets it, and each positive's list gets a floor of its own as soon as it is full.

Every block returns at most a list's length of rows for each list, and lists are cut again by rank, so no task gathers
an anchor's partners. Anchors come in slices, so a task holds one block and one slice.

Defined results: rows with a null id or label, a null vector, or null or non-finite components take no part. Vectors of
unlike lengths are taken as padded with zeros. Repeated rows are rows of their own, but a row with the anchor's id is
never its positive; anchors that repeat with equal labels and vectors are one. Components beyond +-16,384 raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize
from .vectors import integers, usable

SAMPLE, LEAVES = 4_096, 256
#: Rows that a leaf of the top tree should have at least, of one block at most, and anchors of one slice.
LEAST, BLOCK, SLICE = 1_024, 32_768, 4_096
#: Rows of a node that is not split further: candidates, anchors.
SMALL, FEW = 256, 32
#: Candidate leaves that are scored at once.
AT_ONCE = 8
LOWEST = -(1 << 62)


def plane(x: np.ndarray) -> tuple[np.ndarray, float] | None:
    """A direction (between two far ends) and a bound that divide the rows; None if all are equal.

    The bound lies in a wide gap, else halfway between the ends; where a few rows would be cut off, at the median.
    """
    a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    way = x[((x - a) ** 2).sum(axis=1).argmax()] - a
    at = x @ way
    least, most = at.min(), at.max()
    cut = float((least + most) / 2)
    line = np.sort(at)[len(x) // 16 : len(x) - len(x) // 16]
    gap = np.diff(line)
    if len(gap) and gap.max() * 8 > most - least:
        cut = float(line[gap.argmax() : gap.argmax() + 2].mean())
    low = int((at <= cut).sum())
    if min(low, len(x) - low) * 16 < len(x):  # a few rows far out: trees must not get deep
        cut = float(np.median(at))
        if cut == most:
            cut = float(at[at < cut].max(initial=-np.inf))
    return (way, cut) if least <= cut < most else None


class Top:
    """The top of the candidate tree: planes that send a vector to a leaf, and each leaf's centre."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.planes: list[tuple[np.ndarray, float, int, int]] = []  # direction, bound, node at or below it, node above it; ~leaf for a leaf
        self.centres: list[np.ndarray] = []
        self.root = self._grow(sample.astype(np.float64), leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        cut = plane(x) if leaves >= 2 and len(x) >= 2 else None
        if cut:
            k, low = len(self.planes), x @ cut[0] <= cut[1]
            self.planes.append((*cut, 0, 0))
            below, above = self._grow(x[low], leaves // 2), self._grow(x[~low], leaves - leaves // 2)
            self.planes[k] = (*cut, below, above)
            return k
        self.centres.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        return ~(len(self.centres) - 1)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                way, cut, below, above = self.planes[node]
                low = x[rows] @ way <= cut
                todo += [(below, rows[low]), (above, rows[~low])]
        return out


class Forest:
    """Trees over labelled rows, one a label: nodes as arrays, rows in the order of the leaves."""

    def __init__(self, x: np.ndarray, label: np.ndarray, small: int):
        self.x = x.astype(np.float64)
        self.order = np.argsort(label, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(label[self.order])) + 1, len(label)) if len(label) else np.zeros(0, np.int64)
        self.start, self.stop, self.kids, self.label, self.roots = [], [], [], [], []
        begin = 0
        for end in ends.tolist():
            self.roots.append(self._grow(begin, end, int(label[self.order[begin]]), small))
            begin = end
        self.start, self.stop, self.label = np.asarray(self.start), np.asarray(self.stop), np.asarray(self.label)
        self.centre = np.stack([self.x[self.order[a:b]].mean(axis=0) for a, b in zip(self.start, self.stop, strict=True)]) if len(self.start) else np.zeros((0, x.shape[1]))
        self.radius = np.asarray([np.sqrt(((self.x[self.order[a:b]] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.start, self.stop, self.centre, strict=True)])
        self.length = np.sqrt((self.centre**2).sum(axis=1))

    def _grow(self, a: int, b: int, label: int, small: int) -> int:
        k = len(self.start)
        self.start.append(a), self.stop.append(b), self.label.append(label), self.kids.append(None)
        if b - a > small:
            own = self.order[a:b]
            cut = plane(self.x[own])
            low = self.x[own] @ cut[0] <= cut[1] if cut else np.arange(b - a) < (b - a) // 2
            self.order[a:b] = np.concatenate([own[low], own[~low]])
            mid = a + int(low.sum())
            self.kids[k] = (self._grow(a, mid, label, small), self._grow(mid, b, label, small))
        return k

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.stop[node]]


def interval(one: Forest, i: np.ndarray, two: Forest, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the inner products of rows of the nodes i with rows of the nodes j, widened by what floats may err."""
    mid = np.einsum("nd,nd->n", one.centre[i], two.centre[j])
    far = one.length[i] * two.radius[j] + two.length[j] * one.radius[i] + one.radius[i] * two.radius[j]
    far = far + 1e-9 * (1 + far + one.length[i] * two.length[j])
    return mid - far, mid + far


def leaf_pairs(anchors: Forest, cands: Forest, same: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves (and their upper bounds) that may hold scores between each anchor's low and high."""
    floor = np.asarray([low[anchors.rows(k)].min() for k in range(len(anchors.start))])
    roof = np.asarray([high[anchors.rows(k)].max() for k in range(len(anchors.start))])
    pairs = [(a, c) for a in anchors.roots for c in cands.roots if (anchors.label[a] == cands.label[c]) == same]
    found: list[tuple[int, int, float]] = []
    while pairs:
        i, j = np.asarray(pairs).T
        lo, hi = interval(anchors, i, cands, j)
        kept = (hi >= floor[i]) & (lo <= roof[i])
        pairs = []
        for a, c, top in zip(i[kept].tolist(), j[kept].tolist(), hi[kept].tolist(), strict=True):
            if anchors.kids[a] is None and cands.kids[c] is None:
                found.append((a, c, top))
            elif anchors.kids[a] is None or cands.kids[c] is not None and cands.radius[c] >= anchors.radius[a]:
                pairs += [(a, k) for k in cands.kids[c]]
            else:
                pairs += [(k, c) for k in anchors.kids[a]]
    found.sort(key=lambda f: (f[0], -f[2]))
    a, c, top = zip(*found, strict=True) if found else ((), (), ())
    return np.asarray(a, np.int64), np.asarray(c, np.int64), np.asarray(top, np.float64)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: as floats while no sum can reach 2^53, which is faster."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return a @ c.T


def ranked(score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first columns of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ident, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(ident, order, axis=1)


def search(a_vec: np.ndarray, a_id: np.ndarray, a_label: np.ndarray, low: np.ndarray, high: np.ndarray, c_vec: np.ndarray, c_id: np.ndarray, c_label: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first k candidates for each list of each anchor: arrays (anchors, lists, k).

    low and high (anchors, lists) are what a list takes; a place without a candidate has the score LOWEST. With ``same``
    candidates have the anchor's label and another id, else another label.
    """
    lists = low.shape[1]
    best = np.full((len(a_vec), lists, k), LOWEST, np.int64)
    who = np.full((len(a_vec), lists, k), np.iinfo(np.int64).max, np.int64)
    if not len(a_vec) or not len(c_vec):
        return best, who
    anchors, cands = Forest(a_vec, a_label, FEW), Forest(c_vec, c_label, SMALL)
    i, j, top = leaf_pairs(anchors, cands, same, low.min(axis=1), high.max(axis=1))
    for node in np.unique(i).tolist():
        rows = anchors.rows(node)
        own = np.flatnonzero(i == node)
        for at in range(0, len(own), AT_ONCE):
            some = own[at : at + AT_ONCE]
            floor = np.maximum(best[rows, :, -1], low[rows])
            if top[some[0]] < floor.min():
                break  # bounds fall from here on
            cols = np.concatenate([cands.rows(c) for c in j[some].tolist()])
            score = products(a_vec[rows], c_vec[cols])
            if same:
                score[a_id[rows][:, None] == c_id[cols]] = LOWEST
            ident = np.broadcast_to(c_id[cols], score.shape)
            if lists == 1:
                picks = [ranked(np.where((score >= low[rows]) & (score <= high[rows]), score, LOWEST), ident, k)]
            else:
                score, ident = ranked(score, ident, score.shape[1])
                first = (score[:, None, :] > high[rows][:, :, None]).sum(axis=2)
                picks = []
                for m in range(lists):
                    place = first[:, m, None] + np.arange(k)
                    inside = place < score.shape[1]
                    place = np.minimum(place, score.shape[1] - 1)
                    s = np.take_along_axis(score, place, axis=1)
                    picks.append((np.where(inside & (s >= low[rows, m, None]), s, LOWEST), np.take_along_axis(ident, place, axis=1)))
            for m, (s, d) in enumerate(picks):
                best[rows, m], who[rows, m] = ranked(np.concatenate([best[rows, m], s], axis=1), np.concatenate([who[rows, m], d], axis=1), k)
    return best, who


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _vectors(col: pa.Array) -> np.ndarray:
    """Binary vectors of 32-bit integers as rows, shorter ones padded with zeros."""
    parts = [np.frombuffer(b, np.int32) for b in col.to_pylist()]
    out = np.zeros((len(parts), max(map(len, parts), default=0)), np.int64)
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
    return out


def _place(kept: DataFrame, top: Top) -> DataFrame:
    """vec_id, label, anchor, leaf, far (the distance to the leaf's centre) and vec (32-bit integers) of all rows."""
    width = len(top.centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.stack(top.centres)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                lengths = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                x = integers(part.column(3))
                wide = max(width, x.shape[1])
                seen = _padded(x, wide).astype(np.float64)
                leaf = top.leaf(seen[:, :width])
                far = np.sqrt(((seen - _padded(centres, wide)[leaf]) ** 2).sum(axis=1))
                vec = [v[:n].astype(np.int32).tobytes() for v, n in zip(x, lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(leaf), pa.array(far), pa.array(vec, pa.binary())], names=["vec_id", "label", "anchor", "leaf", "far", "vec"])

    return kept.mapInArrow(run, f"vec_id long, label {dict(kept.dtypes)['label']}, anchor boolean, leaf long, far double, vec binary")


class Mine:
    """The placed candidates with their leaves' balls and blocks."""

    def __init__(self, placed: DataFrame, top: Top, anchors: int):
        self.placed, self.centres = placed, np.stack(top.centres)
        n = len(self.centres)
        self.radius, self.parts = np.full(n, -1.0), np.zeros(n, np.int64)
        for leaf, count, far in placed.groupBy("leaf").agg(F.count(F.lit(1)), F.max("far")).collect():
            self.radius[leaf], self.parts[leaf] = far, -(-count // BLOCK)
        self.slices = max(1, -(-anchors // SLICE))

    def _sent(self, anchors: DataFrame, lists: int, home: bool | None) -> DataFrame:
        """Anchors (akey, anchor_id, label, leaf, vec, low, high), once for each block to search; home: only, or all but, their leaf."""
        centres, radius, parts = self.centres, self.radius, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    part = batch.slice(k, 1024)
                    col = {name: part.column(n) for n, name in enumerate(part.schema.names)}
                    x = _vectors(col["vec"])
                    wide = max(x.shape[1], centres.shape[1])
                    x, c = _padded(x, wide).astype(np.float64), _padded(centres, wide)
                    mid, size = x @ c.T, np.sqrt((x**2).sum(axis=1))[:, None]
                    far = size * radius + 1e-9 * (1 + size * (np.sqrt((c**2).sum(axis=1)) + radius))
                    low = np.asarray(col["low"].to_pylist(), np.float64).reshape(len(x), lists).min(axis=1)[:, None]
                    high = np.asarray(col["high"].to_pylist(), np.float64).reshape(len(x), lists).max(axis=1)[:, None]
                    go = (radius >= 0) & (mid + far >= low) & (mid - far <= high)
                    if home is not None:
                        go &= (np.asarray(col["leaf"])[:, None] == np.arange(len(parts))) == home
                    row, leaf = np.nonzero(go)
                    row, leaf = np.repeat(row, parts[leaf]), np.repeat(leaf, parts[leaf])
                    new = np.append(True, (np.diff(row) != 0) | (np.diff(leaf) != 0)) if len(row) else np.zeros(0, bool)
                    piece = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
                    out = part.drop_columns(["leaf"]).take(pa.array(row, pa.int64()))
                    yield out.append_column("leaf", pa.array(leaf, pa.int64())).append_column("part", pa.array(piece, pa.int64()))

        kinds = dict(anchors.dtypes)
        fields = [c for c in anchors.columns if c != "leaf"]
        return anchors.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in fields) + ", leaf long, part long").withColumn("slice", F.pmod(F.xxhash64("akey"), F.lit(self.slices)))

    def lists(self, anchors: DataFrame, k: int, same: bool, lists: int, home: bool | None = None) -> DataFrame:
        """(akey, list, score, vec_id): the first k rows of each block for each list of each anchor."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            empty = {"akey": pa.binary(), "list": pa.int64(), "score": pa.int64(), "vec_id": pa.int64()}
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], t) for c, t in empty.items()})
            a_vec, c_vec = _vectors(left.column("vec").combine_chunks()), _vectors(right.column("vec").combine_chunks())
            wide = max(a_vec.shape[1], c_vec.shape[1])
            names: dict = {}
            code = lambda col: np.asarray([names.setdefault(v, len(names)) for v in col.to_pylist()], np.int64)
            of = lambda name: np.asarray(left.column(name).to_pylist(), np.int64).reshape(left.num_rows, lists)
            best, who = search(_padded(a_vec, wide), np.asarray(left.column("anchor_id")), code(left.column("label")), of("low"), of("high"), _padded(c_vec, wide), np.asarray(right.column("vec_id")), code(right.column("label")), k, same)
            row, m, at = np.nonzero(best > LOWEST)
            return pa.table({"akey": left.column("akey").take(pa.array(row)), "list": pa.array(m, pa.int64()), "score": pa.array(best[row, m, at]), "vec_id": pa.array(who[row, m, at])})

        part = F.pmod(F.xxhash64("vec_id"), F.array(*[F.lit(max(1, int(p))) for p in self.parts])[F.col("leaf").cast("int")])
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.slices - 1).cast("long")))
        block = self.placed.select("vec_id", "label", "vec", "leaf", part.cast("long").alias("part")).select("*", every.alias("slice"))
        key = ["leaf", "part", "slice"]
        found = self._sent(anchors, lists, home).groupBy(*key).cogroup(block.groupBy(*key)).applyInArrow(run, "akey binary, list long, score long, vec_id long")
        return first_of(found, ["akey", "list"], k)


def first_of(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k first rows of each key by score and id, with their rank."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _share(percent: int, up: bool) -> Column:
    """percent * score / 100 as a whole number, rounded down, or up."""
    x = f"({percent if not up else -percent} * score)"
    down = f"({x} - pmod({x}, 100)) div 100"
    return F.expr(f"-({down})" if up else down)


def _as_lists(low: int, high: int) -> list[Column]:
    return [F.array(F.lit(low).cast("long")).alias("low"), F.array(F.lit(high).cast("long")).alias("high")]


def mine(rows: DataFrame, anchor: Column, *, vec: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows (vec_id, label, vec).

    For each anchor its first ``positives`` rows of the same label; for each of these the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    kept = rows.filter(usable(F.col(vec)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec).alias("vec"))
    sample = kept.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).select("vec").toArrow()
    count = kept.count()
    top = Top(integers(sample.column(0).combine_chunks()) if sample.num_rows else np.zeros((0, 0)), min(LEAVES, max(1, count // LEAST)))
    placed = materialize(_place(kept, top), "mine-placed")
    key = F.unhex(F.sha2(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.hex("vec")), 256)).alias("akey")
    anchors = placed.filter("anchor").select(key, F.col("vec_id").alias("anchor_id"), "label", "leaf", "vec").dropDuplicates(["akey"])
    anchors = materialize(anchors, "mine-anchors")
    space = Mine(placed, top, anchors.count())

    own = materialize(space.lists(anchors.select("*", *_as_lists(LOWEST + 1, 1 << 62)), positives, True, 1, True), "mine-own")
    floor = own.filter(F.col("rank") == positives).select("akey", F.col("score").alias("floor"))
    asking = anchors.join(floor, "akey", "left").select(anchors["*"], F.array(F.coalesce("floor", F.lit(LOWEST + 1))).alias("low"), F.array(F.lit(1 << 62)).alias("high"))
    more = space.lists(asking, positives, True, 1, False)
    near = materialize(first_of(own.unionByName(more).drop("rank"), ["akey"], positives).select("akey", "rank", "score", "vec_id"), "mine-positives")

    # a list for each positive: 100 s lies between low * score and high * score
    band = near.select("akey", F.struct("rank", _share(low, True).alias("low"), _share(high, False).alias("high")).alias("band"))
    bands = band.groupBy("akey").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    # every anchor has as many lists: those that are missing take nothing
    listed = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("bands", i)[name], F.lit(none).cast("long")))
    asking = anchors.join(bands, "akey").select(anchors["*"], listed("low", 1 << 62).alias("low"), listed("high", LOWEST + 1).alias("high"))
    hard = space.lists(asking, negatives, False, positives)
    pairs = near.join(anchors.select("akey", "anchor_id"), "akey").select("akey", (F.col("rank") - 1).cast("long").alias("list"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pairs, ["akey", "list"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return out
