from pyspark.sql import functions as F

from claimlens.operators import claims

README = """# Model
We reach a test accuracy of 91.3% here.
Final accuracy is between 84.2 and 85.3 and F1 is 81.2 ± 0.4.

| Model | [Accuracy](x) | Time |
|:--|--:|--|
| [ResNet18](http://a/b) | **93.02%** | 3 h |
| Ours | 94.1 | 2 |

| lr | batch |
|--|--|
| 0.1 | 64 |

```
python train.py --eval_loss=1.0
accuracy: 0.913
```
"""


def rows(spark, text):
    df = spark.createDataFrame([("README.md", text)], "source string, text string")
    return claims.markdown_claims(df).orderBy("ord").collect()


def test_readme(spark):
    out = [(r["line"], r["kind"], r["metric"], r["value"], r["lo"], r["hi"], r["plus_minus"], r["percent"]) for r in rows(spark, README)]
    assert out == [
        (2, "prose", "test_accuracy", 91.3, None, None, None, True),
        (3, "prose", "final_accuracy", None, 84.2, 85.3, None, False),
        (3, "prose", "f1", 81.2, None, None, 0.4, False),
        (7, "table", "accuracy", 93.02, None, None, None, True),
        (7 + 1, "table", "accuracy", 94.1, None, None, None, False),
        (8, "table", "time", 2.0, None, None, None, False),
        (16, "code", "accuracy", 0.913, None, None, None, False),
    ]
    table = [r for r in rows(spark, README) if r["kind"] == "table"]
    assert [(r["row"], r["column"], r["confidence"]) for r in table[:2]] == [("ResNet18", "Accuracy", "high"), ("Ours", "Accuracy", "high")]


def test_empty_and_fenced(spark):
    assert rows(spark, "") == [] and rows(spark, "```\n| acc |\n|--|\n| 1 |\n```") == []


def test_snippet_cuts_long_lines(spark):
    line = "Intro words. " * 30 + "The accuracy is 91.5 on test. " + "More text. " * 30
    text = rows(spark, line)[0]["text"]
    assert text.endswith("...") or text.endswith(".")
    assert "The accuracy is 91.5 on test." in text and len(text) < 200


def test_sentences_and_counts(spark):
    df = spark.createDataFrame([("p", 1, "A mo-\ndel. Accuracy is\n81.5 now. Accuracy of 100 runs.")], "source string, page int, text string")
    out = claims.paper_prose_claims(df).collect()
    assert [(r["value"], r["page"], r["kind"]) for r in out] == [(81.5, 1, "paper-prose")]


def test_identity(spark):
    df = spark.createDataFrame([("acc", 1.0, None, 1), ("acc", 1.0, None, 2), ("acc", 2.0, 3.0, 3)], "metric string, value double, lo double, ord int")
    assert sorted(r["ord"] for r in claims.dedup(df, ["metric", "value", "lo"]).collect()) == [1, 3]
    want = spark.createDataFrame([("acc", None), ("f1", 2.0)], "metric string, lo double")
    got = {r["metric"]: r["claim"] and r["claim"]["ord"] for r in claims.lookup(df, want, ["metric", "lo"]).collect()}
    assert got == {"acc": 1, "f1": None}
    good = spark.createDataFrame([("x", 1.0, None, None)], "source string, value double, lo double, hi double")
    assert claims.manual_claim(good).select(F.col("kind")).first()[0] == "manual"
    import pytest

    with pytest.raises(Exception, match="a claim needs"):
        claims.manual_claim(spark.createDataFrame([("x", None, 1.0, None)], "source string, value double, lo double, hi double")).collect()


def test_lookup_joins_one_claim_a_key_and_keeps_repeated_wanted_rows(spark):
    df = spark.range(2000).selectExpr("IF(id % 2 = 0, 'acc', NULL) AS metric", "id AS ord")
    want = spark.createDataFrame([("acc",), ("acc",), (None,), ("f1",)], "metric string")
    out = claims.lookup(df, want, ["metric"])
    assert sorted((str(r["metric"]), r["claim"] and r["claim"]["ord"]) for r in out.collect()) == [("None", 1), ("acc", 0), ("acc", 0), ("f1", None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {name: [k for k, line in enumerate(plan) if name in line] for name in ("Join", "Aggregate")}
    assert at["Aggregate"] and min(at["Aggregate"]) > min(at["Join"])  # below the join, so no pairs reach an aggregate
