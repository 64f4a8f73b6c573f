"""The append-only evidence log: hash chain, verification in parallel, and replay into state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(entry: dict) -> str:
    """An entry's JSON with sorted keys, without its own hash; non-ASCII stays as it is."""
    return json.dumps({k: v for k, v in entry.items() if k != "hash"}, sort_keys=True, ensure_ascii=False)


def entry_hash(entry: dict) -> str:
    return hashlib.sha256(canonical(entry).encode()).hexdigest()


def _hash_raw(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in raw:
        yield part.map(lambda s: entry_hash(json.loads(s)) if s else None)


def canonical_hash(raw: Column) -> Column:
    """The hash of a raw JSON line, in Arrow batches: byte-exact float and key rendering has no built-in function."""
    return F.pandas_udf(_hash_raw, "string")(raw)


def scan(lines: DataFrame, keep: list[str] | None = None, body: str = "value") -> DataFrame:
    """Log lines -> seq, ts, kind, prev, hash, payload (VARIANT), raw; blank lines do not count."""
    keep = keep or []
    v = F.try_parse_json(body)
    rows = lines.filter(F.trim(body) != "").select(*keep, F.col(body).alias("raw"), v.alias("payload"))
    get = lambda name, kind: F.try_variant_get("payload", f"$.{name}", kind).alias(name)
    return rows.select(*keep, get("seq", "bigint"), get("ts", "string"), get("kind", "string"), get("prev", "string"), get("hash", "string"), "payload", "raw")


def build(rows: DataFrame, study: str, order: str, content: str) -> DataFrame:
    """Chain each study's contents in order: adds seq, prev and hash = sha256(prev | content).

    The fold is sequential, so it runs as one grouped pass per study; studies run in parallel.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        prev, prevs, hashes = GENESIS, [], []
        for text in part[content]:
            prevs.append(prev)
            prev = hashlib.sha256(f"{prev}|{text}".encode()).hexdigest()
            hashes.append(prev)
        return part.assign(seq=range(1, len(part) + 1), prev=prevs, hash=hashes)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(study).applyInPandas(run, f"{schema}, seq long, prev string, hash string")


def _object(payload: str) -> dict:
    out = json.loads(payload) if payload else None
    if not isinstance(out, dict):
        raise ValueError(f"a payload is no JSON object: {payload!r:.80}")
    return out


def chain(rows: DataFrame, heads: DataFrame, ts: str) -> DataFrame:
    """study, seq, ts, kind, prev, hash and raw of rows (study, kind, payload, ord), behind heads (study, head_seq, head_hash).

    The hash is that of the entry's canonical JSON, which holds seq and prev. A task folds its studies one after the other as
    their rows stream in by ord, and holds no more than the hash before.
    """
    names = ["study", "seq", "ts", "kind", "prev", "hash", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        study, seq, prev = None, 0, GENESIS
        for batch in batches:
            out = []
            for own, kind, payload, head_seq, head_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None:
                    raise ValueError("an entry needs a study")
                if own != study:
                    study, seq, prev = own, head_seq or 0, head_hash or GENESIS
                seq += 1
                entry = {**_object(payload), "seq": seq, "ts": ts, "kind": kind, "prev": prev}
                entry["hash"] = digest = entry_hash(entry)
                out.append((study, seq, ts, kind, prev, digest, json.dumps(entry, sort_keys=True, ensure_ascii=False)))
                prev = digest
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    joined = rows.select(F.col("study").cast("string").alias("study"), "kind", "payload", "ord").join(heads, "study", "left")
    sorted_ = joined.repartition("study").sortWithinPartitions("study", "ord").select("study", "kind", "payload", "head_seq", "head_hash")
    return sorted_.mapInArrow(run, "study string, seq long, ts string, kind string, prev string, hash string, raw string")


#: Entries of a study that one window holds.
SEGMENT = 1 << 16


def verify(log: DataFrame, study: str, recomputed: Column, seq: str = "seq", segment: int = SEGMENT) -> DataFrame:
    """Problems of each entry: chain (prev is not the stored hash before it) and content (its own hash is wrong).

    Both tests need only the entry and its predecessor's stored hash, so no fold is needed. Entries are taken in segments of
    ``segment`` numbers, so no task holds a whole study: a segment's first entry is compared with the last one of the segment
    before, and only these last entries, one a segment, are in order over the study. Entries without a number come first.
    """
    place = F.struct(seq, "hash")
    log = log.withColumn("_key", F.coalesce(F.col(study).cast("string"), F.lit("\0"))).withColumn("_segment", F.coalesce(F.floor(F.col(seq) / segment), F.lit(-1)))
    ends = log.groupBy("_key", "_segment").agg(F.max_by("hash", place).alias("_last"))
    ends = ends.select("_key", "_segment", F.lag("_last").over(Window.partitionBy("_key").orderBy("_segment")).alias("_outside"))
    inside = Window.partitionBy("_key", "_segment").orderBy(seq, "hash")
    out = log.withColumn("_inside", F.lag("hash").over(inside)).withColumn("_first", F.row_number().over(inside) == 1).join(ends, ["_key", "_segment"])
    before = F.coalesce(F.when(F.col("_first"), F.col("_outside")).otherwise(F.col("_inside")), F.lit(GENESIS))
    out = out.withColumn("_before", before).withColumn("_again", recomputed)
    problems = F.array_compact(F.array(F.when(~F.col("prev").eqNullSafe(F.col("_before")), "chain broken"), F.when(~F.col("hash").eqNullSafe(F.col("_again")), "content hash mismatch")))
    return out.withColumn("problems", problems).drop("_key", "_segment", "_inside", "_first", "_outside", "_before", "_again")


def verify_files(stated: DataFrame, found: DataFrame) -> DataFrame:
    """stated (path, sha256) against found (path, sha256): file missing, or file changed; null when it is right."""
    f = found.select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha"))
    problem = F.when(F.col("f_path").isNull(), "file missing").when(F.col("f_sha") != F.col("sha256"), "file changed")
    return stated.join(f, F.col("path") == F.col("f_path"), "left").select(*stated.columns, problem.alias("problem"))


def replay(log: DataFrame, keys: list[str], ident: str = "id", seq: str = "seq") -> DataFrame:
    """The last entry of each id, in the order in which the ids first came."""
    rest = [c for c in log.columns if c not in (*keys, ident)]
    last = log.groupBy(*keys, ident).agg(F.max_by(F.struct(*rest), seq).alias("_r"), F.min(seq).alias("first_seq"))
    return last.select(*keys, ident, "_r.*", "first_seq")


def active_env(envs: DataFrame, key: str) -> DataFrame:
    """The environment in force: the last good one, unless a later failure restored none. envs: id, status, restored, seq."""
    good = F.max_by("id", F.when(F.col("status") == "ok", F.col("seq")))
    good_seq = F.max(F.when(F.col("status") == "ok", F.col("seq")))
    broken_seq = F.max(F.when((F.col("status") != "ok") & F.col("restored").isNull(), F.col("seq")))
    out = envs.groupBy(key).agg(good.alias("_g"), good_seq.alias("_gs"), broken_seq.alias("_bs"))
    return out.select(key, F.when(F.col("_bs").isNull() | (F.col("_gs") > F.col("_bs")), F.col("_g")).alias("active_env"))


def next_id(log: DataFrame, keys: list[str], prefix: str, kind: str) -> DataFrame:
    """prefix and one more than the entries of a kind so far."""
    n = F.count(F.when(F.col("kind") == kind, 1))
    return log.groupBy(*keys).agg(F.concat(F.lit(prefix), (n + 1).cast("string")).alias("next_id"))
