import json
import threading

import pytest
from pyspark.sql import functions as F

from claimlens.functions.numbering import numbered
from claimlens.operators import evidence
from claimlens.sources import shared
from claimlens.sources.chainlog import ChainLog

ROW = "study string, kind string, payload string, ord long"


def rows(spark, *items):
    return spark.createDataFrame([(s, "note", json.dumps({"text": t}, ensure_ascii=False), k) for k, (s, t) in enumerate(items)], ROW)


def texts(log, study):
    return [json.loads(r["raw"])["text"] for r in log.entries().filter(F.col("study") == study).orderBy("seq").collect()]


def sound(log):
    """Every study's numbers are 1, 2, …, every entry follows the one before, and hashes are those of canonical JSON."""
    entries = evidence.scan(log.entries().select("study", F.col("raw").alias("value")), ["study"])
    bad = evidence.verify(entries, "study", evidence.canonical_hash(F.col("raw")), segment=3).filter(F.size("problems") > 0).count()
    counts = log.entries().groupBy("study").agg(F.count("*").alias("n"), F.max("seq").alias("top"), F.countDistinct("seq").alias("d")).collect()
    return bad == 0 and all(r["n"] == r["top"] == r["d"] for r in counts)


def test_appends_go_on_where_the_chain_ends(spark, tmp_path):
    log = ChainLog(spark, f"file://{tmp_path}/log")
    assert log.entries().count() == 0 and log.manifests() == []
    assert log.append(rows(spark, ("a", "one"), ("b", "é"), ("a", "two")), ts="t") == 1
    assert log.append(rows(spark, ("a", "three"), ("c", "new"))) == 2
    assert texts(log, "a") == ["one", "two", "three"] and texts(log, "b") == ["é"] and sound(log)
    first = log.entries().filter("study = 'a' and seq = 1").first()
    want = {"kind": "note", "prev": evidence.GENESIS, "seq": 1, "text": "one", "ts": "t"}
    assert first["hash"] == evidence.entry_hash(want) and json.loads(first["raw"]) == {**want, "hash": first["hash"]}


def test_a_token_is_appended_once(spark, tmp_path):
    log = ChainLog(spark, f"file://{tmp_path}/log")
    batch = rows(spark, ("a", "one"))
    assert [log.append(batch, token="x"), log.append(batch, token="x"), log.append(batch, token="y")] == [1, 1, 2]
    assert texts(log, "a") == ["one", "one"] and sound(log)


def test_what_was_not_published_is_not_seen(spark, tmp_path, monkeypatch):
    log = ChainLog(spark, f"file://{tmp_path}/log")
    log.append(rows(spark, ("a", "one")))
    with monkeypatch.context() as m:
        m.setattr(ChainLog, "_publish", lambda *a: (_ for _ in ()).throw(OSError("the driver dies")))
        with pytest.raises(OSError):
            log.append(rows(spark, ("a", "lost")))
    assert texts(log, "a") == ["one"]
    log.append(rows(spark, ("a", "two")))
    assert texts(log, "a") == ["one", "two"] and sound(log)


@pytest.mark.parametrize("payload", ["[]", "no json", None])
def test_a_bad_row_fails_the_whole_append(spark, tmp_path, payload):
    log = ChainLog(spark, f"file://{tmp_path}/log")
    bad = spark.createDataFrame([("a", "note", "{}", 1), ("a", "note", payload, 2)], ROW)
    with pytest.raises(Exception):
        log.append(bad)
    assert log.manifests() == [] and log.entries().count() == 0


def test_two_writers_at_once_leave_one_chain(spark, tmp_path):
    failures = []

    def write(who):
        try:
            log = ChainLog(spark, f"file://{tmp_path}/log")
            for k in range(3):
                log.append(rows(spark, ("a", f"{who}{k}"), ("a", f"{who}{k}'"), (who, "own")))
        except Exception as e:
            failures.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "xyz"]
    [t.start() for t in threads], [t.join() for t in threads]
    log = ChainLog(spark, f"file://{tmp_path}/log")
    assert not failures and sound(log) and len(log.manifests()) == 9
    seen = texts(log, "a")
    assert sorted(seen) == sorted(f"{w}{k}{x}" for w in "xyz" for k in range(3) for x in ("", "'"))
    assert all([t for t in seen if t[0] == w] == [f"{w}{k}{x}" for k in range(3) for x in ("", "'")] for w in "xyz")
    assert not list((tmp_path / "log" / "drafts").glob("*.json"))


def test_a_second_writer_of_a_version_loses(spark, tmp_path):
    log = ChainLog(spark, f"file://{tmp_path}/log")
    log.append(rows(spark, ("a", "one")))
    assert not log._publish(1, {"version": 1, "token": "t", "name": "other"})
    assert log.manifests()[0]["name"] != "other"


@pytest.mark.parametrize("segment", [1, 3, 7, 1 << 16])
def test_segments_find_the_same_problems(spark, segment):
    rows, prev = [], evidence.GENESIS
    for k in [*range(1, 40), *range(90, 100), 400]:  # gaps as wide as several segments
        rows.append(("s", k, "broken" if k % 11 == 0 else prev, f"h{k}"))
        prev = f"h{k}"
    rows += [("t", 1, evidence.GENESIS, "h1"), (None, 1, evidence.GENESIS, "h1"), (None, 2, "h1", "h2"), ("u", None, evidence.GENESIS, "h")]
    df = spark.createDataFrame(rows, "study string, seq long, prev string, hash string").repartition(5)
    out = evidence.verify(df, "study", F.when(F.col("seq") % 5 == 0, "other").otherwise(F.col("hash")), segment=segment)
    assert out.columns == ["study", "seq", "prev", "hash", "problems"]
    for r in out.collect():
        want = (["chain broken"] if r["study"] == "s" and r["seq"] % 11 == 0 else []) + (["content hash mismatch"] if r["seq"] and r["seq"] % 5 == 0 else [])
        assert r["problems"] == want, r


def test_numbers_over_ranges(spark):
    items = [(k % 3 if k < 50 else 7, k * 37 % 501) for k in range(500)] + [(None, k) for k in range(20)]
    df = spark.createDataFrame(items, "key int, at int").repartition(6)
    out = numbered(df, ["key"], ["at"])
    got = {(r["key"], r["at"]): r["n"] for r in out.collect()}
    for key in (0, 1, 2, 7, None):
        own = sorted(a for k, a in items if k == key)
        assert [got[(key, a)] for a in own] == list(range(1, len(own) + 1))
    assert out.columns == ["key", "at", "n"]
    assert numbered(df.limit(0), ["key"], ["at"]).count() == 0
    assert sorted(r["n"] for r in numbered(df, [], ["at"]).collect()) == list(range(1, 521))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
