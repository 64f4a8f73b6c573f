import json

from pyspark.sql import functions as F

from claimlens.operators import evidence, report
from claimlens.streaming import watch


def chain(n=4):
    out, prev = [], evidence.GENESIS
    for k in range(1, n + 1):
        e = {"seq": k, "ts": "2025-01-01T00:00:00Z", "kind": "run" if k % 2 else "note", "prev": prev, "text": f"é {k}", "x": 0.1 * k}
        e["hash"] = prev = evidence.entry_hash(e)
        out.append(e)
    return out


def problems(spark, entries):
    df = spark.createDataFrame([("s", json.dumps(e, ensure_ascii=False)) for e in entries] + [("s", "  ")], "study string, value string")
    log = evidence.scan(df, ["study"])
    return {r["seq"]: r["problems"] for r in evidence.verify(log, "study", evidence.canonical_hash(F.col("raw"))).collect()}


def test_verify(spark):
    entries = chain()
    assert problems(spark, entries) == {k: [] for k in range(1, 5)}
    entries[1]["text"] = "other"
    assert problems(spark, entries)[2] == ["content hash mismatch"]
    entries = chain()
    entries[2]["prev"] = "0"
    assert problems(spark, entries)[3] == ["chain broken", "content hash mismatch"]


def test_build_then_verify(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "study string, at int, content string")
    built = evidence.build(df, "study", "at", "content")
    again = F.sha2(F.concat_ws("|", "prev", "content"), 256)
    assert all(not r["problems"] for r in evidence.verify(built, "study", again).collect())
    assert {(r["study"], r["at"]): r["seq"] for r in built.collect()} == {("a", 1): 1, ("a", 2): 2, ("b", 1): 1}


def test_replay_env_ids(spark):
    log = spark.createDataFrame([("s", "c1", 1, "old"), ("s", "c2", 2, "x"), ("s", "c1", 3, "new")], "study string, id string, seq int, v string")
    got = [(r["id"], r["v"]) for r in evidence.replay(log, ["study"]).orderBy("first_seq").collect()]
    assert got == [("c1", "new"), ("c2", "x")]
    envs = spark.createDataFrame([("a", "e1", "ok", None, 1), ("a", "e2", "failed", None, 2), ("b", "e1", "ok", None, 1), ("b", "e2", "failed", "e1", 2)], "study string, id string, status string, restored string, seq int")
    assert {r["study"]: r["active_env"] for r in evidence.active_env(envs, "study").collect()} == {"a": None, "b": "e1"}


def test_reports(spark):
    c = spark.createDataFrame([("s", f"c{i}", i) for i in range(8)], "study string, claim_id string, ord int")
    done = spark.createDataFrame([("s", "c0", True, 1)], "study string, claim_id string, shortened boolean, n int")
    row = report.not_compared(c, done, "study").first()
    assert (row["n"], row["sample"]) == (7, [f"c{i}" for i in range(1, 7)])
    notes = spark.createDataFrame([("s", "not_checked", "left")], "study string, note_kind string, text string")
    texts = [r["text"] for r in report.not_checked(c, done, notes, "study").orderBy("rank").collect()]
    assert texts[0].endswith("c6 and 1 more") and texts[-1] == "left" and len(texts) == 4
    import pytest

    with pytest.raises(Exception, match="known kind"):
        report.add_notes(notes.withColumn("note_kind", F.lit("odd"))).collect()


def arrive(spark, src, lines):
    spark.createDataFrame(lines, "study string, value string").coalesce(1).write.mode("append").json(src)


def streamed(spark, out):
    return {(r["study"], r["seq"]): r["problems"] for r in spark.read.parquet(out).collect()}


def test_shuffled_stream_gives_the_result_of_a_batch(spark, tmp_path):
    import random

    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    entries = chain(24)
    entries[7]["text"] = "edited"  # its content
    entries[15]["prev"] = "0"  # its link, and so its content
    lines = [(study, json.dumps(e, ensure_ascii=False)) for study in ("s", "t") for e in entries]
    random.Random(3).shuffle(lines)
    df = spark.createDataFrame(lines, "study string, value string")
    log = evidence.scan(df, ["study"])
    want = {(r["study"], r["seq"]): r["problems"] for r in evidence.verify(log, "study", evidence.canonical_hash(F.col("raw"))).collect()}
    for at in range(0, len(lines), 16):
        arrive(spark, src, lines[at : at + 16])
        watch.run_available(spark, src, out, mark)
    assert streamed(spark, out) == want
    assert want["s", 8] == ["content hash mismatch"] and want["t", 16] == ["chain broken", "content hash mismatch"]


def test_a_gap_is_given_up_after_a_while(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    lines = [("s", json.dumps(e, ensure_ascii=False)) for e in chain(6)]
    arrive(spark, src, [lines[0], lines[2], lines[3], lines[5]])
    watch.run_available(spark, src, out, mark, patience_ms=1)
    arrive(spark, src, [("other", lines[0][1])])
    watch.run_available(spark, src, out, mark, patience_ms=1)
    arrive(spark, src, [("third", lines[0][1]), lines[1]])
    watch.run_available(spark, src, out, mark, patience_ms=1)
    got = streamed(spark, out)
    assert {k[1]: v for k, v in got.items() if k[0] == "s"} == {1: [], 2: ["chain broken"], 3: ["chain broken"], 4: [], 6: ["chain broken"]}
