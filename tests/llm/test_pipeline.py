import random

from pyspark.sql import functions as F

import corpus_pipeline
from claimlens.llm import linededup, neardup

from .conftest import WORDS
from .test_lines import brute as brute_lines
from .test_neardup import brute as brute_near


def make(spark, tmp_path):
    """A small corpus with one of everything that a stage removes."""
    rng = random.Random(8)
    sent = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(9))
    texts, toxic = [], []
    for k in range(120):
        bad = k % 6 == 0
        lines = [sent() + "." for _ in range(rng.randint(2, 5))]
        if bad:
            lines = [x + " vilewordau stupidous." for x in lines]
        texts.append("\n".join(lines))
        toxic.append(int(bad))
    shared = "this very line is found in many of the documents of the corpus"
    item = " ".join(sent() for _ in range(3))
    for k in range(1, 120, 7):
        texts[k] += "\n" + shared
    texts[2], texts[4] = texts[1].replace(shared, "") + " end", texts[3]
    texts[8] += "\nintro " + item.upper() + " outro"
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(None, "null id", None, None, None), (500, None, None, None, None), (501, "", "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, toxic


def test_stages(spark, tmp_path):
    d, texts, toxic = make(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    state = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        state.append(docs)
    after = [{r["doc_id"]: r["text"] for r in s.collect()} for s in state[:4]]
    assert not [k for k, y in enumerate(toxic) if y and k in after[0]] and all(k in after[0] for k, y in enumerate(toxic) if not y)
    want = brute_lines(after[0])
    gone = {k for k, (t, _, n) in want.items() if n and not t.strip(linededup.STRIP)}
    assert after[1] == {k: t if t is None and not n else text for k, t in after[0].items() if k not in gone for text, _, n in [want[k]]}
    ids = sorted(k for k in after[1] if k is not None)
    comps, _ = brute_near([after[1][k] for k in ids], 5, 80)
    keep = {k for i, k in enumerate(ids) if comps[i] == i} | {None}
    assert set(after[2]) == keep
    assert set(after[3]) == keep - {8}
    assert {r["doc_id"] for r in state[4].collect()} == set(after[3])


def test_run_equals_its_stages(spark, tmp_path):
    d, _, _ = make(spark, tmp_path)
    rows = corpus_pipeline.run(spark, d)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(rows.columns)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    assert neardup.plan(80)[0] > neardup.plan(85)[0]


def test_null_and_reused_ids_are_decided_row_by_row(spark, tmp_path):
    d, texts, _ = make(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    shared = "this very line is found in many of the documents of the corpus"
    copy = " ".join(f"word{k}" for k in range(80))
    odd = {"toxic": texts[0], "clean": "a clean text", "line": f"kept line one\n{shared}", "other": f"kept line two\n{shared}", "leak": f"intro {item} outro", "copy": copy + " end"}
    for key in (None, 900):
        rows = spark.createDataFrame([(key, t, "en", "s", len(t)) for t in odd.values()], docs.schema)
        more = docs.filter("doc_id is not null").unionByName(rows).unionByName(spark.createDataFrame([(700, copy, "en", "s", 1)], docs.schema)).withColumn("text_key", F.lit("x")).withColumn("gone_id", F.lit(1))
        of = lambda x: sorted(r["text"] for r in x.filter(F.col("doc_id").eqNullSafe(F.lit(key))).collect())  # noqa: B023, E731
        assert of(corpus_pipeline.drop_toxic(spark, more, d)) == sorted(t for n, t in odd.items() if n != "toxic")
        assert of(corpus_pipeline.decontaminate(spark, more, d)) == sorted(t for n, t in odd.items() if n != "leak")
        near = corpus_pipeline.dedup_near(spark, more, d)
        assert near.columns == list(corpus_pipeline.COLUMNS)
        # the copy's smallest doc_id is 700; the toxic text is that of document 0; a null id has no links
        assert of(near) == sorted(t for n, t in odd.items() if key is None or n not in ("copy", "toxic"))
        lines = of(corpus_pipeline.dedup_lines(spark, more, d))
        assert len(lines) == 6 and len(set(lines)) == 6 and {"a clean text", odd["toxic"]} <= set(lines)
        if key is None:
            assert {"kept line one", "kept line two"} <= set(lines)
