"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, confirmation on full shingle sets.

1. Texts with equal shingle sets form a class, so exact copies are one row from here on.
2. A class gets a signature of lanes of b = 16 bits, each from a minimum over its hashed shingles. The Hamming distance of
   two signatures is the number of lanes that differ; a lane differs with probability 1 - J.
3. The signature is split into m chunks of ``WIDTH`` lanes. Two signatures at distance d have, by the pigeonhole principle,
   a chunk with at most d // m errors. One error a chunk is allowed and enumerated: each chunk gives one key for each lane
   left out, so every pair with d <= 2 m - 1 meets under some key. That is the distance bound, without exception; m is the
   least number for which a pair right at the similarity threshold is beyond the bound with a probability under ``MISS``.
4. Stars: each class is put beside the nearest representative of its buckets that is within the bound; full sets are
   compared inside each star, and found links contract into components.
5. Settling: buckets that still hold several components are gathered by their most frequent component. Its members and
   the others that met them (the probes) are rows of one group, once however many buckets they share. Probes are
   compared with all rows of other components: by signature distance first, then on full sets. Large groups are dealt out
   as (part of the probes, part of the rows), so no task holds more than two parts, and a task returns at most one link
   for each two components that it joins.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing. Rows are decided one by one:
a doc_id with several texts has a row and a component for each; a null doc_id is a document of its own without links. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, buffers, forget, materialize, mix, slices, text_key, word_hashes
from .components import connected_components

WIDTH = 5
MISS = 1e-5
#: Classes of a star's part, and of a part of a settled group.
STAR, PART = 400, 2_000
#: Shingles of one part; longer texts share a part with fewer others.
PART_SHINGLES = 400_000
#: Bytes of text that are hashed at once.
SLICE = 500_000
#: Classes (24 bytes each) that may be broadcast to fetch their texts; beyond it all texts are shuffled to them.
BROADCAST_CLASSES = 500_000
_LANE_SEEDS = np.random.default_rng(77).integers(1, 2**32, (2, 1024), dtype=np.uint32) | np.uint32(1)
_ORDER = np.random.default_rng(78).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def plan(percent: int) -> tuple[int, int]:
    """(chunks m, bound 2 m - 1 on the distance) for a similarity of ``percent`` / 100."""
    differ = 1 - percent / 100
    m = 1
    while True:
        lanes, bound = m * WIDTH, 2 * m - 1
        if sum(math.comb(lanes, d) * differ**d * (1 - differ) ** (lanes - d) for d in range(bound + 1, lanes + 1)) <= MISS:
            return m, bound
        m += 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with 1 to size - 1 words is one shingle."""
    words, at = word_hashes(raw, offsets)
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : n - size + 1 + k] * _ORDER[k] if n >= size else 0
    rolled = mix(rolled)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            few = words[a:b] * _ORDER[32 : 32 + b - a]
            out.append(mix(np.asarray([few.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """Rows of 16-bit lanes; the sets must not be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), lanes), np.uint16)
    h, shifted = np.empty_like(flat), np.empty_like(flat)
    for k in range(lanes):
        np.multiply(flat, _LANE_SEEDS[0, k], out=h)
        np.right_shift(h, np.uint32(15), out=shifted)
        np.bitwise_xor(h, shifted, out=h)
        np.multiply(h, _LANE_SEEDS[1, k], out=h)
        out[:, k] = np.minimum.reduceat(h, starts) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature one 64-bit key for each chunk and lane left out."""
    n, lanes = sig.shape
    keys = np.empty((n, lanes), np.uint64)
    terms = mix((sig.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + np.arange(lanes, dtype=np.uint64))
    for c in range(lanes // WIDTH):
        part = terms[:, c * WIDTH : (c + 1) * WIDTH]
        total = part.sum(axis=1, dtype=np.uint64)
        for k in range(WIDTH):
            keys[:, c * WIDTH + k] = mix(total - part[:, k] + np.uint64((c * WIDTH + k) * 0xA0761D6478BD642F % 2**64))
    return keys


def _rows(docs: DataFrame, size: int, lanes: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (a digest of the set) and, for each non-empty text, its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", SLICE):
            sets = shingle_sets(*buffers(batch.column(2)), size)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full, lanes)) if full else iter(())
            rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(sig).tobytes()) if len(s) else (None, None) for s in sets]
            arrays = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])

    return docs.select("doc_id", text_key().alias("text_key"), body().alias("body")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, sig binary")


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _keyed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                keys = chunk_keys(_lanes(part.column(1)))
                cids = np.repeat(np.asarray(part.column(0)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(cids)], names=["key", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "key long, cid long")


def _codes(values: list) -> np.ndarray:
    """Equal values as equal small integers."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(v, len(seen)) for v in values), np.int64, len(values))


def link_sets(comps: list, sets: list[np.ndarray], percent: int, probe: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) with 100 |A and B| >= percent |A or B| that join different components; enough to join all that can be.

    Each set is compared, through an index of all shingles, with every set of at least its least possible size at once.
    With ``probe`` only pairs with a probe among them are compared.
    """
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(n), [len(sets[i]) for i in order])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    size = np.asarray([len(sets[i]) for i in order], np.int64)
    comp = _codes([comps[i] for i in order])
    asks = np.ones(n, bool) if probe is None else probe[order]
    out = []
    for x in range(1, n):
        lo = int(np.searchsorted(size[:x], -(-percent * int(size[x]) // 100), side="left"))
        open_ = comp[lo:x] != comp[x]
        if not asks[x]:
            open_ &= asks[lo:x]
        if not open_.any():
            continue
        s = sets[order[x]]
        a, b = np.searchsorted(flat, s, side="left"), np.searchsorted(flat, s, side="right")
        k = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        common = np.bincount(owner[at], minlength=n)[lo:x]
        union = size[lo:x] + size[x] - common
        for y in (np.flatnonzero(open_ & (100 * common >= percent * union)) + lo).tolist():
            if comp[x] != comp[y]:
                comp[comp == comp[y]] = comp[x]
                out.append((int(order[x]), int(order[y])))
    return out


def _verify(groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) among the rows (gid, cid, comp, probe) of each group, on full sets; texts: cid, body.

    What a group joins comes as stars: each class with the smallest one that it is joined with.
    """

    def run(table: pa.Table) -> pa.Table:
        first: dict[int, int] = {}
        for k, cid in enumerate(table.column("cid").to_pylist()):
            first.setdefault(cid, k)  # equal rows of documents give a class its text more than once
        ids, least = list(first), {}
        if len(ids) > 1:
            table = table.take(pa.array(list(first.values()))).combine_chunks()
            sets = []
            for part in slices(iter(table.select(["body"]).to_batches()), "body", SLICE):
                sets += shingle_sets(*buffers(part.column(0)), size)
            joined = {k: [k] for k in range(len(ids))}
            for i, j in link_sets(table.column("comp").to_pylist(), sets, percent, np.asarray(table.column("probe"))):
                if joined[i] is not joined[j]:
                    small, large = sorted((joined[i], joined[j]), key=len)
                    large += small
                    joined.update(dict.fromkeys(small, large))
            least = {ids[k]: min(ids[x] for x in own) for k, own in joined.items() if own[0] == k or len(own) > 1}
        rows = [(a, c) for c, a in least.items() if a < c]
        return pa.table({"a": pa.array([x[0] for x in rows], pa.int64()), "b": pa.array([x[1] for x in rows], pa.int64())})

    return groups.join(texts, "cid").groupBy("gid").applyInArrow(run, "a long, b long").distinct()


def _near_rows(rows: DataFrame, bound: int) -> DataFrame:
    """Of the rows (gid, cid, comp, asks, sig): those with a partner of another component within ``bound`` in their group.

    A row that asks is a probe and is compared with the rows that do not ask; the result has a row for each class.
    """

    def run(table: pa.Table) -> pa.Table:
        sig = _lanes(table.column("sig").combine_chunks())
        asks = np.asarray(table.column("asks"))
        comp = _codes(table.column("comp").to_pylist())
        at, to = np.flatnonzero(asks), np.flatnonzero(~asks)
        keep = np.zeros(len(sig), bool)
        lanes = np.ascontiguousarray(sig[to].T)
        for i in at.tolist():
            far = np.zeros(len(to), np.uint16)
            for k, lane in enumerate(lanes):
                far += lane != sig[i, k]
            near = (far <= bound) & (comp[to] != comp[i])
            keep[i] = near.any()
            keep[to] |= near
        kept = table.filter(pa.array(keep))
        probes = {c for c, a in zip(kept.column("cid").to_pylist(), kept.column("asks").to_pylist(), strict=True) if a}
        first = {c: k for k, c in reversed(list(enumerate(kept.column("cid").to_pylist())))}
        kept = kept.take(pa.array(list(first.values()), pa.int64()))
        return kept.select(["gid", "cid", "comp"]).append_column("probe", pa.array([c in probes for c in first], pa.bool_()))

    return rows.groupBy("gid").applyInArrow(run, "gid binary, cid long, comp long, probe boolean")


def _distances(pairs: DataFrame) -> DataFrame:
    """(cid, rep, far, shingles) of rows (cid, rep, sig, rep_sig, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_lanes(batch.column(2)) != _lanes(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int64()), batch.column(4)], names=["cid", "rep", "far", "shingles"])

    return pairs.select("cid", "rep", "sig", "rep_sig", "shingles").mapInArrow(run, "cid long, rep long, far long, shingles long")


def _parts(n: Column, shingles: Column, most: int) -> Column:
    """Parts for so many classes with so many shingles, each of about ``most`` classes."""
    return F.greatest(F.ceil(n / most), F.ceil(shingles / PART_SHINGLES), F.lit(1))


def _gid(*columns: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *[c.cast("string") for c in columns])))


def _dealt(cid: str, parts: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(cid, F.lit(salt)), parts)


def _stars(buckets: DataFrame, classes: DataFrame, bound: int) -> DataFrame:
    """(gid, cid, comp, probe): each class beside the nearest representative of its buckets (key, cid, rep)."""
    pairs = buckets.filter("cid <> rep").select("cid", "rep").distinct().join(classes.select("cid", "sig", "shingles"), "cid")
    both = pairs.join(classes.select(F.col("cid").alias("rep"), F.col("sig").alias("rep_sig")), "rep")
    best = _distances(both).filter(F.col("far") <= bound).groupBy("cid").agg(F.min(F.struct("far", "rep", "shingles")).alias("best"))
    stars = materialize(best.select("cid", "best.rep", "best.shingles"), "neardup-stars")
    sizes = stars.groupBy("rep").agg(_parts(F.count(F.lit(1)), F.sum("shingles"), STAR).alias("parts"))
    members = stars.join(sizes, "rep").select("cid", _gid(F.col("rep"), _dealt("cid", F.col("parts"))).alias("gid"))
    heads = sizes.select(F.col("rep").alias("cid"), "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("cid", _gid(F.col("rep"), F.col("part")).alias("gid"))
    return members.unionByName(heads).select("gid", "cid", F.col("cid").alias("comp"), F.lit(True).alias("probe"))


def _mixed(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, cid, comp) of the buckets that hold more than one component."""
    rows = buckets.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(several, "key")


def _settled(rows: DataFrame, classes: DataFrame, bound: int) -> DataFrame:
    """(gid, cid, comp, probe) of what is left to compare among the mixed buckets' rows (key, cid, comp).

    Two classes of different components in a bucket are both in the group of the bucket's most frequent component, and
    one of them is not of that component, so it is a probe.
    """
    most = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("home"))
    group = rows.join(most, "key").select("home", "cid", "comp").distinct().join(classes.select("cid", "shingles", "sig"), "cid")
    group = materialize(group, "neardup-left")
    probe = F.col("comp") != F.col("home")
    count = lambda c: (F.count(F.when(c, 1)), F.coalesce(F.sum(F.when(c, F.col("shingles"))), F.lit(0)))
    sizes = group.groupBy("home").agg(_parts(*count(probe), PART).alias("ps"), _parts(*count(F.lit(True)), PART).alias("qs"))
    group = group.join(sizes, "home")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = group.withColumn("q", _dealt("cid", F.col("qs"))).withColumn("p", span("ps")).withColumn("asks", F.lit(False))
    asking = group.filter(probe).withColumn("p", _dealt("cid", F.col("ps"), 1)).withColumn("q", span("qs")).withColumn("asks", F.lit(True))
    dealt = asked.select("home", "p", "q", "cid", "comp", "asks", "sig").unionByName(asking.select("home", "p", "q", "cid", "comp", "asks", "sig"))
    return _near_rows(dealt.select(_gid(F.col("home"), F.col("p"), F.col("q")).alias("gid"), "cid", "comp", "asks", "sig"), bound)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept; one row per input row.

    With ``keyed`` also text_key (a hash of the row's text), which tells the rows of a repeated doc_id apart.
    """
    chunks, bound = plan(percent)
    docs = docs.select("doc_id", "text")
    per_row = materialize(_rows(docs, shingle, chunks * WIDTH), "neardup-rows")
    named = per_row.filter("doc_id is not null and set_key is not null")
    first = F.min(F.struct("doc_id", "text_key"))
    classes = named.groupBy("set_key").agg(first.alias("row"), F.first("sig").alias("sig"), F.first("n_shingles").alias("shingles"))
    classes = materialize(classes.select("set_key", "row", F.col("row.doc_id").alias("cid"), "sig", "shingles"), "neardup-classes")
    reused = classes.groupBy("cid").count().filter("count > 1").select(F.col("cid").alias("reused"))
    if not reused.isEmpty():  # classes of one id with several texts: told apart by a hash of their sets
        apart = classes.join(reused, F.col("cid") == F.col("reused"), "left")
        cid = F.when(F.col("reused").isNull(), F.col("cid")).otherwise(F.xxhash64("set_key"))
        classes = materialize(apart.select("set_key", "row", cid.alias("cid"), "sig", "shingles"), "neardup-classes")
    keys = _keyed(classes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("rep")).filter("n > 1").select("key", "rep")
    buckets = materialize(keys.join(shared, "key"), "neardup-buckets")
    met = buckets.select("cid").distinct().join(classes, "cid").select("cid", F.col("row.doc_id").alias("row_id"), F.col("row.text_key").alias("row_key"))
    met = materialize(met, "neardup-met")
    few = F.broadcast(met) if met.count() <= BROADCAST_CLASSES else met
    own = [F.col("doc_id") == F.col("row_id"), text_key() == F.col("row_key")]
    texts = materialize(docs.join(few, own).select("cid", body().alias("body")), "neardup-texts")

    links = materialize(_verify(_stars(buckets, classes, bound), texts, shingle, percent), "neardup-links")
    comps = connected_components(links)
    left = _settled(_mixed(buckets, comps), classes, bound)
    more = _verify(materialize(left, "neardup-left"), texts, shingle, percent)
    comps = connected_components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    # a copy reaches what its class reaches
    of_class = classes.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").select("set_key", F.coalesce("component", "cid").alias("component"), "row.doc_id")
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reach = of_class.join(least, "component").select("set_key", "component_id")
    out = named.join(reach, "set_key").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = per_row.filter("doc_id is null or set_key is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    for table in (buckets, texts, met):
        forget(table)
    out = out.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    return out if keyed else out.drop("text_key")
