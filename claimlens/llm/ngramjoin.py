"""Documents linked by the Jaccard similarity of their word n-grams: a grouped prefix join, exact on full sets.

1. All sets use one order of the n-grams: frequent ones last, else by hash. Document frequencies are counted over all documents
   for the hashes below ``REGION``, where prefixes lie; n-grams beyond it count as rare. The order decides the speed only:
   any common order gives the same links.
2. Of a set of n n-grams the first n - ceil(t n) + 1 in this order are its prefix: two sets with a similarity of at least t
   share an n-gram of their prefixes. Texts with equal sets are one class from here on; classes with identical prefixes and
   sizes collapse into one group, and only groups are joined.
3. Groups that share a prefix n-gram are a bucket. First each group is put beside the bucket's first group with which it
   shares most of its prefix, and each class beside its group's first; full sets are compared inside these stars, and
   links contract into components. So a family of near copies costs a row for each class, not one for each pair.
4. What is left are pairs of groups of different components. In buckets of up to ``LIGHT`` groups they are joined, and kept if
   their sizes allow the similarity and so do the places of a common n-gram (some common n-gram is the first one: what
   is behind it bounds the overlap). Then whole prefixes bound the overlap: common n-grams up to the end of the prefix that
   ends first, and all that is left of its set. Surviving pairs are expanded into members and verified on full sets.
5. In larger buckets the members of the most frequent component, and all others (the probes), form a gathering that is dealt into cells
   of part of the probes and part of the rows; the prefix bound filters inside a cell, and what survives is verified. A
   cell returns at most a link for each two components that it joins.

Defined results: words are separated by space and 9 to 13, A-Z are lower-cased. Null, empty and wordless texts have an empty set and
are linked with nothing; with fewer words than n the whole sequence is one n-gram. Rows are decided one by one: a doc_id with
several texts has a row for each; a null doc_id is a document of its own without links. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, buffers, forget, materialize, slices, text_key
from .components import connected_components
from .neardup import BROADCAST_CLASSES, PART, SLICE, STAR, _dealt, _gid, _parts, _verify, shingle_sets

#: Hashes below this are counted; prefixes of 15 or 20 % of a set rarely go beyond it.
REGION = np.uint64(3 << 61)
#: Documents that make an n-gram frequent, and how many frequent ones are told to all tasks (8 bytes each) at most.
FREQUENT, MOST_FREQUENT = 64, 1_000_000
#: Counted n-grams that a task holds before it gives them out, and bytes of text for each range of hashes.
HELD, RANGE_BYTES = 1_000_000, 8_000_000
#: Groups of a bucket that are joined pair by pair; larger buckets are dealt into cells.
LIGHT = 64
_HEAVY = np.uint64(1 << 63)


def _counted(docs: DataFrame, size: int) -> DataFrame:
    """(token, df) of the counted n-grams in at least ``FREQUENT`` documents."""
    ranges = max(64, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    width = -(-int(REGION) // ranges)

    def given(held: list[np.ndarray]) -> pa.RecordBatch:
        token, df = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(token, (np.arange(ranges + 1, dtype=object) * width).astype(np.uint64))
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)) if b > a]
        cut = lambda x: pa.array([x[a:b].tobytes() for _, a, b in spans], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int64()), cut(token), cut(df.astype(np.uint32))], names=["range", "tokens", "dfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, "body", SLICE):
            for s in shingle_sets(*buffers(batch.column(0)), size):
                low = s[: np.searchsorted(s, REGION)].copy()  # a view would hold the whole set
                held.append(low)
                n += len(low)
            if n >= HELD:
                yield given(held)
                held, n = [], 0
        if n:
            yield given(held)

    def add(table: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint64)
        df = np.frombuffer(b"".join(table.column("dfs").to_pylist()), np.uint32)
        token, at = np.unique(token, return_inverse=True)
        total = np.bincount(at, df).astype(np.int64)
        often = total >= FREQUENT
        return pa.table({"token": pa.array(token[often].view(np.int64)), "df": pa.array(total[often])})

    return docs.select(body().alias("body")).mapInArrow(run, "range long, tokens binary, dfs binary").groupBy("range").applyInArrow(add, "token long, df long")


def frequent_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """The sorted hashes of the frequent n-grams, at most ``MOST_FREQUENT`` of them: the bound on df doubles until they fit."""
    counted, least = materialize(_counted(docs, size), "jaccard-frequent"), FREQUENT
    while counted.filter(F.col("df") >= least).count() > MOST_FREQUENT:
        least *= 2
    out = counted.filter(F.col("df") >= least).select("token").toArrow().column(0).to_numpy().view(np.uint64)
    forget(counted)
    return np.sort(out)


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places of the n-grams in the common order, sorted: 63 bits of the hash, above them whether it is frequent."""
    places = tokens >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        places = np.where(frequent[at] == tokens, places | _HEAVY, places)
    return np.sort(places)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _rows(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (a digest of the set), group_key (of prefix and size) and prefix of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda b: hashlib.blake2b(b, digest_size=16).digest()
        for batch in slices(batches, "body", SLICE):
            sets = shingle_sets(*buffers(batch.column(2)), size)
            prefixes = [ordered(s, frequent)[: prefix_length(len(s), percent)] if len(s) else s for s in sets]
            ends = np.cumsum([0, *map(len, prefixes)])
            keys = [(digest(s.tobytes()), digest(p.tobytes() + len(s).to_bytes(8, "little"))) if len(s) else (None, None) for s, p in zip(sets, prefixes, strict=True)]
            flat = np.concatenate(prefixes).view(np.int64) if len(prefixes) else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            arrays = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.binary()), prefix]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_shingles", "set_key", "group_key", "prefix"])

    schema = "doc_id long, text_key long, n_shingles long, set_key binary, group_key binary, prefix array<long>"
    return docs.select("doc_id", text_key().alias("text_key"), body().alias("body")).mapInArrow(run, schema)


def _fits(percent: int, n: Column, m: Column, overlap: Column) -> Column:
    """An overlap of sets of n and m elements that is enough for the similarity."""
    return overlap * (100 + percent) >= (n + m) * percent


def _star_rows(stars: DataFrame) -> DataFrame:
    """(gid, cid, comp, probe) of classes (cid, rep, n) beside their rep, in parts of about ``STAR`` classes."""
    sizes = stars.groupBy("rep").agg(_parts(F.count(F.lit(1)), F.sum("n"), STAR).alias("parts"))
    members = stars.join(sizes, "rep").select("cid", _gid(F.col("rep"), _dealt("cid", F.col("parts"))).alias("gid"))
    heads = sizes.select(F.col("rep").alias("cid"), "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("cid", _gid(F.col("rep"), F.col("part")).alias("gid"))
    return members.unionByName(heads).select("gid", "cid", F.col("cid").alias("comp"), F.lit(True).alias("probe"))


def _cells(rows: DataFrame) -> DataFrame:
    """(gid, cid, comp, probe): rows (home, cid, comp, probe, n) dealt so that each probe meets each row of its home in one cell."""
    probe = F.col("probe")
    of = lambda c: (F.count(F.when(c, 1)), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)))
    sizes = rows.groupBy("home").agg(_parts(*of(probe), PART).alias("ps"), _parts(*of(F.lit(True)), PART).alias("qs"))
    rows = rows.join(sizes, "home")
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = rows.withColumn("q", _dealt("cid", F.col("qs"))).withColumn("p", span("ps")).withColumn("probe", F.lit(False))
    asking = rows.filter(probe).withColumn("p", _dealt("cid", F.col("ps"), 1)).withColumn("q", span("qs"))
    cols = ["home", "p", "q", "cid", "comp", "probe"]
    dealt = asked.select(*cols).unionByName(asking.select(*cols))
    return dealt.groupBy(_gid(F.col("home"), F.col("p"), F.col("q")).alias("gid"), "cid").agg(F.first("comp").alias("comp"), F.max("probe").alias("probe"))


def most_common(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """A bound on the overlap of sets of n and m elements with the prefixes x and y."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return min(n, m, common + (n - len(x) if x[-1] <= y[-1] else m - len(y)))


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, n, m, pa, pb) those whose prefixes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k) for k in (4, 5))
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            of = lambda c, k: c[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
            keep = [most_common(of(x, k), n[k], of(y, k), m[k]) * (100 + percent) >= (n[k] + m[k]) * percent for k in range(len(x))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n", "m", "pa", "pb").mapInArrow(run, "a long, b long")


def _near(cells: DataFrame, percent: int) -> DataFrame:
    """Of the cells' rows (gid, cid, comp, probe, n, prefix) those with a partner that their prefixes allow."""

    def run(table: pa.Table) -> pa.Table:
        n = np.asarray(table.column("n"))
        names: dict = {}
        comp = np.asarray([names.setdefault(c, len(names)) for c in table.column("comp").to_pylist()])
        prefix = [np.asarray(p, np.int64).view(np.uint64) for p in table.column("prefix").to_pylist()]
        length, last = np.asarray([len(p) for p in prefix]), np.asarray([p[-1] for p in prefix])
        flat = np.concatenate(prefix)
        owner = np.repeat(np.arange(len(n)), length)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        keep = np.zeros(len(n), bool)
        for i in np.flatnonzero(np.asarray(table.column("probe"))).tolist():
            a, b = np.searchsorted(flat, prefix[i], side="left"), np.searchsorted(flat, prefix[i], side="right")
            k = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            common = np.bincount(owner[at], minlength=len(n))
            most = np.minimum(common + np.where(last[i] <= last, n[i] - length[i], n - length), np.minimum(n, n[i]))
            near = (common > 0) & (comp != comp[i]) & (most * (100 + percent) >= (n + n[i]) * percent)
            keep |= near
            keep[i] |= near.any()
        return table.select(["gid", "cid", "comp", "probe"]).filter(pa.array(keep))

    return cells.groupBy("gid").applyInArrow(run, "gid binary, cid long, comp long, probe boolean")


def _components_of(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with comp, their component so far."""
    return members.join(comps.select(F.col("node").alias("cid"), F.col("component").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _light_rows(rows: DataFrame, members: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Cells to verify for the pairs of groups in the small buckets' rows (token, gid, comp, n, pos)."""
    a, b = rows.select("token", *[F.col(c).alias(f"a_{c}") for c in ("gid", "comp", "n", "pos")]), rows.select("token", *[F.col(c).alias(f"b_{c}") for c in ("gid", "comp", "n", "pos")])
    n, m = F.col("a_n"), F.col("b_n")
    behind = 1 + F.least(n - F.col("a_pos") - 1, m - F.col("b_pos") - 1)
    met = a.join(b, "token").filter((F.col("a_comp") != F.col("b_comp")) & (F.struct("a_n", "a_gid") <= F.struct("b_n", "b_gid")) & (m * percent <= n * 100) & _fits(percent, n, m, behind))
    pairs = met.select(F.col("a_gid").alias("a"), F.col("b_gid").alias("b")).distinct()
    of = lambda g, n, p: groups.select(F.col("gid").alias(g), F.col("n").alias(n), F.col("prefix").alias(p))
    likely = materialize(_likely(pairs.join(of("a", "n", "pa"), "a").join(of("b", "m", "pb"), "b"), percent), "jaccard-likely")
    own = likely.select(F.col("a").alias("home")).distinct().join(members, F.col("home") == F.col("gid")).select("home", "cid", "comp", "n", F.lit(True).alias("probe"))
    other = likely.filter("a <> b").select(F.col("a").alias("home"), "b").join(members, F.col("b") == F.col("gid")).select("home", "cid", "comp", "n", F.lit(False).alias("probe"))
    return _cells(own.unionByName(other))


def _heavy_rows(rows: DataFrame, members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Cells to verify for the large buckets' rows (token, gid, comp)."""
    most = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m")).select("token", F.col("m.comp").alias("home"))
    homes = rows.join(most, "token").select("home", "gid", "comp").distinct()
    own = homes.join(members, ["gid", "comp"]).select("home", "cid", "comp", "n", (F.col("comp") != F.col("home")).alias("probe"))
    return _near(_cells(own).join(classes.select("cid", "n", "prefix"), "cid"), percent)


def jaccard_components(docs: DataFrame, *, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links); one row per input row."""
    docs = docs.select("doc_id", "text")
    per_row = materialize(_rows(docs, shingle, percent, frequent_tokens(docs, shingle)), "jaccard-rows")
    named = per_row.filter("doc_id is not null and set_key is not null")
    classes = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"), F.first("group_key").alias("group_key"), F.first("prefix").alias("prefix"))
    classes = materialize(classes.withColumn("cid", F.col("row.doc_id")), "jaccard-classes")
    reused = classes.groupBy("cid").count().filter("count > 1").select(F.col("cid").alias("reused"))
    if not reused.isEmpty():  # classes of one id with several texts: told apart by a hash of their sets
        apart = classes.join(reused, F.col("cid") == F.col("reused"), "left")
        cid = F.when(F.col("reused").isNull(), F.col("cid")).otherwise(F.xxhash64("set_key"))
        classes = materialize(apart.withColumn("cid", cid).drop("reused"), "jaccard-classes")

    # classes with identical prefixes and sizes are one group, named by its first class
    first = classes.groupBy("group_key").agg(F.min("cid").alias("gid"))
    members = materialize(classes.select("cid", "n", "group_key").join(first, "group_key").select("cid", "n", "gid"), "jaccard-members")
    groups = classes.join(members.filter("cid = gid").select("gid"), F.col("cid") == F.col("gid"), "left_semi").select(F.col("cid").alias("gid"), "n", "prefix")
    tokens = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("gid").alias("rep")).filter("size > 1")
    buckets = materialize(tokens.join(shared, "token"), "jaccard-buckets")

    # stars: each group beside the bucket's first group that shares most with it, each class beside its group's first
    pairs = buckets.filter("gid <> rep").groupBy("gid", "rep").agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n"))
    pairs = pairs.join(members.filter("cid = gid").select(F.col("gid").alias("rep"), F.col("n").alias("m")), "rep")
    ahead = lambda c: F.ceil(F.col(c) * percent / 100) - 1
    possible = _fits(percent, F.col("n"), F.col("m"), F.least("n", "m", F.col("common") + F.greatest(ahead("n"), ahead("m"))))
    best = pairs.filter(possible).groupBy("gid").agg(F.max(F.struct("common", "rep", "n")).alias("best")).select(F.col("gid").alias("cid"), "best.rep", "best.n")
    stars = materialize(best.unionByName(members.filter("cid <> gid").select("cid", F.col("gid").alias("rep"), "n")), "jaccard-stars")

    def texts_of(rows: DataFrame) -> DataFrame:
        met = rows.select("cid").distinct().join(classes, "cid").select("cid", F.col("row.doc_id").alias("row_id"), F.col("row.text_key").alias("row_key"))
        met = materialize(met, "jaccard-met")
        few = F.broadcast(met) if met.count() <= BROADCAST_CLASSES else met
        return docs.join(few, [F.col("doc_id") == F.col("row_id"), text_key() == F.col("row_key")]).select("cid", body().alias("body"))

    def linked(rows: DataFrame) -> DataFrame:
        rows = materialize(rows, "jaccard-cells")
        return materialize(_verify(rows, texts_of(rows), shingle, percent), "jaccard-links")

    comps = connected_components(linked(_star_rows(stars)))

    # the rest: buckets that hold several components
    members = materialize(_components_of(members, comps), "jaccard-members")
    own = members.select("gid", "comp").distinct()
    inner = members.select(F.col("gid").alias("token"), "gid", "n", F.lit(0).alias("pos")).distinct()  # a group is a bucket of its own
    rows = buckets.select("token", "gid", "n", "pos").unionByName(inner).join(own, "gid")
    mixed = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token", "size")
    rows = materialize(rows.join(mixed, "token"), "jaccard-mixed")
    more = linked(_light_rows(rows.filter(F.col("size") <= LIGHT), members, groups, percent).unionByName(_heavy_rows(rows.filter(F.col("size") > LIGHT), members, classes, percent)))
    if not more.isEmpty():
        comps = connected_components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    # a copy reaches what its class reaches
    of_class = _components_of(classes.select("cid", "set_key", "row.doc_id"), comps)
    least = of_class.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    reach = of_class.join(least, "comp").select("set_key", "component_id")
    out = named.join(reach, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = per_row.filter("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    for done in (buckets, stars, rows):
        forget(done)
    return out.unionByName(alone)
