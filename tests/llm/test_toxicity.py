import random

import pytest
from pyspark.sql import functions as F

from claimlens.llm import queries, toxicity
from claimlens.llm.common import sample_ids

from .conftest import WORDS, frame

BAD = ["idiotical", "stupidous", "vilewordau", "vilewordei", "vileworden"]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        sents = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                sents[rng.randrange(len(sents))] += " " + rng.choice(BAD)
        texts.append(". ".join(sents) + ".")
        labels.append(int(toxic))
    return texts, labels


def test_held_out_and_location():
    texts, labels = corpus()
    model = toxicity.fit(texts, labels)
    more, truth = corpus(200, seed=2)
    got = [model.score(t)[0] >= 0.5 for t in more]
    assert sum(g != bool(t) for g, t in zip(got, truth)) <= 2
    text = "All is well here. You are idiotical and stupidous. Good bye."
    (found,) = [s for s in model.sentences(text) if s[2] >= 0.5]
    assert text[found[0] : found[1]].strip() == "You are idiotical and stupidous"
    # an ending never seen in training: the stem decides
    assert model.score("they are vilewordxyz.")[0] > 0.5
    # a document's probability is one minus the product over its sentences
    p = [s[2] for s in model.sentences(text)]
    rest = 1.0
    for x in p:
        rest *= 1 - x
    assert model.score(text)[0] == pytest.approx(1 - rest, rel=1e-6)


def test_long_clean_text_stays_clean():
    model = toxicity.fit(*corpus())
    assert model.score("and to in is that. " * 3000)[0] < 0.5


def test_spark_and_odd_rows(spark, odd_texts, with_null_id):
    texts, labels = corpus()
    docs = frame(spark, texts)
    marks = spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)] + [(0, 1, labels[0]), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, F.lit(True))
    rows = toxicity.score(with_null_id(odd_texts), model).collect()
    assert len(rows) == len(odd_texts) + 1
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["score"] == by[1]["score"] == by[2]["score"] == 0 and by[5]["score"] == by[6]["score"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.train(docs.union(docs), marks.union(marks), F.lit(True)).weights == model.weights
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.locate(frame(spark, ["x. you idiotical stupidous. y", None]), model).count() == 1


def test_nothing_to_learn_from(spark):
    docs = frame(spark, ["a b", "c"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_query(spark):
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len({r["doc_id"] for r in out}) == len(out) and all(r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_samples_do_not_depend_on_repeats(spark):
    ids = spark.range(100).select(F.col("id").alias("doc_id"))
    rows = ids.crossJoin(spark.range(50).select(F.lit(1).alias("x"))).unionByName(spark.createDataFrame([(None, 1)] * 300, "doc_id long, x int"))
    for n in (1, 60, 100, 150):
        got = {r[0] for r in sample_ids(rows, n).collect()}
        assert len(got) == min(n, 100) and got == {r[0] for r in sample_ids(ids, n).collect()}
    many = spark.range(60_000).select(F.col("id").alias("doc_id"))
    first = sorted(r[0] for r in sample_ids(many, 500).collect())
    assert len(first) == 500 and first == sorted(r[0] for r in sample_ids(many.union(many).union(many), 500).collect())
