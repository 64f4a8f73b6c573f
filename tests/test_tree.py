import hashlib
import os

import pytest
from pyspark.sql import functions as F

from claimlens.sources import tree
from claimlens.sources.files import SKIP_FOLDERS


@pytest.fixture
def folder(tmp_path):
    for path, body in {"b.txt": "b", "a.txt": "aa", "z/1": "x" * 10, "a/2": "é", "a/1": "", "a/deep/er/f": "f", "a b/#%20.txt": "odd", ".git/x": "no", "a/node_modules/y": "no", "a/.hidden": "h"}.items():
        file = tmp_path / "top" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body)
    return tmp_path / "top"


def spec(root, limit=10**9):
    """A walk as plain Python says it."""
    out = []
    for at, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in SKIP_FOLDERS)
        for name in sorted(names):
            out.append(os.path.relpath(os.path.join(at, name), root))
            if len(out) == limit:
                return out
    return out


@pytest.mark.parametrize("folders", [1, 3, 64])
def test_walk_order_pruning_and_limit(spark, folder, monkeypatch, folders):
    monkeypatch.setattr(tree, "FOLDERS", folders)  # the driver opens few folders, or all
    paths = [r["path"] for r in tree.walk(spark, str(folder)).orderBy("ord").collect()]
    assert paths == spec(folder) and len(paths) == 8
    assert [r["path"] for r in tree.walk(spark, f"file://{folder}", 3).collect()] == spec(folder, 3)
    rows = {r["path"]: r for r in tree.tree(spark, str(folder)).collect()}
    assert rows["a/2"]["size"] == 2 and rows["a.txt"]["mtime"] == (folder / "a.txt").stat().st_mtime_ns


def test_other_folders_can_be_skipped(spark, folder):
    tree.tree(spark, str(folder))
    got = spark.read.format("tree").option("skip", "a").load(str(folder))
    assert sorted(r["path"] for r in got.collect()) == [".git/x", "a b/#%20.txt", "a.txt", "b.txt", "z/1"]


def test_size_filters_reach_the_listing(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        big = tree.tree(spark, str(folder)).filter("size >= 2 and size < 10 and path like 'a%'")
        assert sorted(r["path"] for r in big.collect()) == ["a b/#%20.txt", "a.txt", "a/2"]
        plan = big._jdf.queryExecution().executedPlan().toString()
        above = plan.split("Filter", 1)[-1].split("\n")[0]
        assert "StartsWith" in above and "<" not in above and ">" not in above  # the path is tested above the scan, the size in it
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_no_or_empty_folder(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert tree.walk(spark, str(tmp_path / "empty")).count() == tree.walk(spark, str(tmp_path / "none")).count() == 0


def test_hashes_are_streamed_up_to_a_limit(spark, tmp_path):
    large = tmp_path / "large"
    with large.open("wb") as f:
        f.truncate(3 << 30)  # sparse, and larger than any array of Java's
    (tmp_path / "small").write_bytes(b"abc" * (1 << 20))
    files = spark.createDataFrame([("large", 1), ("small", 2), ("none", 3), (None, 4)], "path string, sha256 int").select("path", F.col("sha256").alias("k"))
    got = {r["path"]: r["sha256"] for r in tree.with_hashes(files, str(tmp_path), limit=50 << 20).collect()}
    assert got == {"large": None, "small": hashlib.sha256(b"abc" * (1 << 20)).hexdigest(), "none": None, None: None}
    zeros = hashlib.sha256()
    for _ in range(3 << 10):
        zeros.update(bytes(1 << 20))
    whole = tree.with_hashes(files.filter("path = 'large'"), f"file://{tmp_path}").first()
    assert whole["sha256"] == zeros.hexdigest()


def test_changes_between_snapshots(spark, folder, monkeypatch):
    monkeypatch.setattr(tree, "MAX_LISTED", 2)
    keep = tree.snapshot(spark, str(folder))
    before = spark.createDataFrame(keep.collect(), keep.schema)
    (folder / "new").mkdir()
    for name, body in {"new/1": "one", "new/2": "two", "b.txt": "changed"}.items():
        (folder / name).write_text(body)
    (folder / "z" / "1").unlink()
    got = {r["path"]: (r["change"], r["listed"], r["sha256"]) for r in tree.changes(before, tree.snapshot(spark, str(folder)), str(folder)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"b.txt": ("modified", True, sha("changed")), "new/1": ("created", True, sha("one")), "new/2": ("created", False, None), "z/1": ("deleted", False, None)}
