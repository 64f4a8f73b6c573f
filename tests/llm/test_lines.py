import random
from collections import defaultdict

from pyspark.sql import functions as F

from claimlens.llm import linededup

from .conftest import frame

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(texts, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for k, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(k)
    out = {}
    for k, t in texts.items():
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(h := holders.get(key(x), ())) >= min_docs and k != max(h))]
        out[k] = ("\n".join(kept), len(ls), len(ls) - len(kept))
    return out


def corpus():
    rng = random.Random(4)
    pool = [f"shared line number {k} with enough characters in it é" for k in range(12)] + ["short one", "", "  "]
    own = lambda: "a line of its own " + str(rng.random()) + " that is long enough here"
    texts = {}
    for k in range(80):
        ls = [rng.choice(pool) if rng.random() < 0.5 else own() for _ in range(rng.randint(0, 9))]
        texts[k] = "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r"]) for x in ls)
    return texts


def test_equals_brute_force(spark, monkeypatch):
    texts = corpus()
    df = frame(spark, list(texts.values()))
    want = brute(texts)
    for hot in (2_000, 6):  # with all lines cold, and with hot ones
        monkeypatch.setattr(linededup, "HOT", hot)
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect()}
        assert got == want


def test_odd_rows(spark, odd_texts, with_null_id):
    long_line = "this line is certainly longer than forty characters"
    texts = odd_texts + [long_line] * 6
    df = with_null_id(texts)
    df = df.union(df.filter("doc_id = 10"))
    rows = linededup.dedup_lines(df).collect()
    assert len(rows) == df.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["text"], by[0]["n_lines"]) == ("", 1) and by[8]["n_lines"] == 3
    assert [by[k]["n_dropped"] for k in range(10, 16)] == [1, 1, 1, 1, 1, 0]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_levelled_and_mark_new_lines(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    batches = [[("a", 1), ("b", 1)], [("a", 2), ("c", 2)], [("a", 3)]]
    for rows in batches:
        runs.add(spark.createDataFrame(rows, "h string, doc_id long").select(F.col("h").cast("binary").alias("hash"), "doc_id"))
    assert [len(x) for x in runs.levels] == [1, 1]
    total = {bytes(r["hash"]).decode(): (r["n_docs"], r["max_doc"]) for r in runs.frequent(1).collect()}
    assert total == {"a": (3, 3), "b": (1, 1), "c": (1, 2)}
    marks = [{bytes(r["hash"]).decode(): r["is_new"] for r in run.collect()} for level in reversed(runs.levels) for run in level]
    assert marks == [{"a": True, "b": True, "c": True}, {"a": False}]
    # a new batch is merged with the older runs where they lie: no run is moved or sorted
    last = spark.createDataFrame([("a", 4), ("d", 4)], "h string, doc_id long").select(F.col("h").cast("binary").alias("hash"))
    for run in runs.runs():
        last = last.join(run.select("hash").hint("merge"), "hash", "left_anti")
    assert [bytes(r[0]) for r in last.collect()] == [b"d"]
    plan = last._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") - plan.count("QueryStage") <= 1 and plan.count("SortMergeJoin") == 2
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("claimlens_line_run")]


def test_the_marks_decide_what_is_added_up(spark):
    rng = random.Random(9)
    rows = [(f"h{int(rng.paretovariate(0.6))}", rng.randint(0, 60)) for _ in range(1500)]
    want = defaultdict(set)
    for h, d in rows:
        want[h].add(d)
    runs = linededup.LineRuns(spark, fanout=3)
    for k in range(5):
        part = [x for x in rows if x[1] % 5 == k]
        runs.add(spark.createDataFrame(part, "h string, doc_id long").select(F.col("h").cast("binary").alias("hash"), "doc_id"))
    got = {bytes(r["hash"]).decode(): (r["n_docs"], r["max_doc"]) for r in runs.frequent(3).collect()}
    assert got == {h: (len(d), max(d)) for h, d in want.items() if len(d) >= 3}
    runs.close()


def test_one_long_text_and_reused_ids(spark):
    line = "a line that is repeated and longer than forty characters, number "
    texts = ["\n".join(f"{line}{k % 900}" for k in range(20_000))] + ["\n".join(f"{line}{k}" for k in range(900))] * 5
    df = frame(spark, texts).union(spark.createDataFrame([(5, f"{line}3\nown", "en", "s", 1, "x", 1, "y"), (2, f"mine\n{line}4", "en", "s", 1, "x", 1, "y")], frame(spark, ["x"]).schema))
    rows = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"][:4]) for r in linededup.dedup_lines(df).collect())
    assert rows == sorted([(0, 20_000, 20_000, ""), *[(k, 900, 900, "") for k in range(1, 5)], (5, 900, 0, "a li"), (5, 2, 0, "a li"), (2, 2, 1, "mine")])
