from claimlens.operators import select


def test_selectors_of_all_forms(spark):
    rows = [("m1", "m1.1", "loss", "r1", 2.0, 1), ("m1", "m1.2", "loss", "r2", 1.0, 2), ("m1", "m1.3", "loss", "r1", 1.0, 3), ("m1", "m1.4", "test_accuracy", None, 0.5, 4), ("m2", "m2.1", "lr", "r1", 9.0, 1)]
    values = spark.createDataFrame(rows, "extraction string, id string, name string, run string, value double, ord long")
    want = {
        "m1.4": [(None, "m1.4", 0.5, 1, None)], " m1:loss ": [(None, "m1.3", 1.0, 3, None)], "m1:loss:first": [(None, "m1.1", 2.0, 3, None)],
        "m1:loss:min": [(None, "m1.2", 1.0, 3, None)], "m1:loss:max": [(None, "m1.1", 2.0, 3, None)], "m1:Test Acc": [(None, "m1.4", 0.5, 1, None)],
        "m1:loss:last@r1": [("r1", "m1.3", 1.0, 2, None)], "m1:loss:max@each": [("r1", "m1.1", 2.0, 2, None), ("r2", "m1.2", 1.0, 1, None)],
        "m1:loss@r9": [("r9", None, None, 0, "No 'loss' values in m1. Names found: loss, test_accuracy")], "m2:none": [(None, None, None, 0, "No 'none' values in m2. Names found: lr")],
        "m1.9": [(None, None, None, 0, "No value 'm1.9' in m1")], "m7:loss": [(None, None, None, 0, "Unknown metrics extraction 'm7'")], "m1:loss:mean": [(None, None, None, 0, "Bad selector 'm1:loss:mean'")],
        "loss": [(None, None, None, 0, "Bad selector 'loss'")], "": [(None, None, None, 0, "Bad selector ''")], "m1.4@r1": [(None, None, None, 0, "Bad selector 'm1.4@r1'")],
    }
    wanted = spark.createDataFrame([(s,) for s in [*want, "m1.4"]], "selector string")
    got = {}
    for r in select.resolve(values, wanted).collect():
        got.setdefault(r["selector"], []).append((r["run"], r["id"], r["value"], r["n"], r["problem"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == want
    assert select.resolve(values.limit(0), wanted.limit(1)).first()["problem"] == "Unknown metrics extraction 'm1'"
