import pytest
from pyspark.sql import functions as F

from claimlens.operators import select, verdict

CLAIM = "claim_id string, metric string, value double, lo double, hi double, plus_minus double, percent boolean, value_text string, lo_text string, hi_text string, tol double, rel double, close double"


def run(spark, claim, measured, **options):
    base = dict.fromkeys(x.split()[0] for x in CLAIM.split(", ")) | {"claim_id": "c", "percent": False} | claim
    claims = spark.createDataFrame([tuple(base.values())], CLAIM)
    rows = [("c", *m) for m in measured]
    m = spark.createDataFrame(rows, "claim_id string, value double, percent boolean, run string, scope string, origin string, unsourced boolean")
    return verdict.compare(claims, m, **options).first()


def value(x, percent=False, run="r1", scope="full", origin="repo", unsourced=False):
    return (x, percent, run, scope, origin, unsourced)


def test_rounding_of_the_text_widens(spark):
    r = run(spark, {"metric": "accuracy", "value": 99.0, "value_text": "99", "percent": True, "tol": 0.1}, [value(0.9862)], tol="tol")
    assert (r["verdict"], r["tol_abs"], round(r["mean"], 6)) == ("reproduced", 0.5, 98.62)


@pytest.mark.parametrize("close, expected", [(None, "close"), (0.02, "not_reproduced")])
def test_close_band(spark, close, expected):
    r = run(spark, {"metric": "val_loss", "value": 1.88, "value_text": "1.88", "rel": 0.01, "close": close and close * 1.88}, [value(1.92)], rel="rel", close="close")
    assert (r["verdict"], r["direction"]) == (expected, "worse")


def test_range_over_runs(spark):
    r = run(spark, {"metric": "accuracy", "lo": 84.2, "hi": 85.3, "lo_text": "84.2", "hi_text": "85.3", "percent": True, "tol": 0.1, "close": 1.0}, [value(0.842), value(0.847, run="r2"), value(0.842, run="r3")], tol="tol", close="close")
    assert (r["verdict"], r["n"], round(r["mean"], 4), round(r["std"], 6)) == ("reproduced", 3, 84.3667, 0.288675)
    out = run(spark, {"metric": "accuracy", "lo": 85.3, "hi": 84.2, "percent": True}, [value(0.80)])
    assert (out["verdict"], round(out["distance"], 6)) == ("not_reproduced", 4.2)


def test_overrides(spark):
    claim = {"metric": "f1", "value": 81.2, "value_text": "81.2"}
    typed = run(spark, claim, [value(81.0, unsourced=True)])
    assert (typed["verdict"], typed["counts_as_reproduction"]) == ("reproduced", False)
    short = run(spark, claim, [value(81.2, scope="smoke", origin="authored")])
    assert (short["verdict"], short["numbers_alone"], short["label"]) == ("inconclusive", "reproduced", "INCONCLUSIVE (reduced-scale smoke check)")
    own = run(spark, claim, [value(50.0, origin="authored")])
    assert own["label"] == "REIMPLEMENTED (numbers differ)"
    assert run(spark, claim, [value(81.2, scope="setup")])["verdict"] == "reproduced"
    assert run(spark, claim, [value(float("nan"))])["verdict"] == "not_reproduced"
    assert run(spark, claim, [value(81.2), value(81.2)])["same_run_twice"]


@pytest.mark.parametrize(
    "kind, error, timed_out, reason",
    [
        (None, None, None, "other"),
        ("env", "x", False, "broken_deps"),
        ("run", "AssertionError: Torch not compiled with CUDA enabled", True, "gpu_required"),
        ("run", "slow", True, "timeout"),
        ("run", "urllib.error.HTTPError: HTTP Error 404: Not Found", False, "data_unavailable"),
        ("run", "FileNotFoundError: no data/x.csv", False, "data_unavailable"),
        ("run", "ValueError: shape", False, "run_failed"),
    ],
)
def test_blocking_reason(spark, kind, error, timed_out, reason):
    df = spark.createDataFrame([(kind, error, timed_out)], "k string, e string, t boolean")
    assert df.select(verdict.blocking_reason(F.col("k"), F.col("e"), F.col("t"))).first()[0] == reason


def test_selectors(spark):
    df = spark.createDataFrame([(1, 3.0, "a"), (2, 1.0, "a"), (3, 2.0, "b"), (4, 1.0, "b"), (5, 3.0, "b")], "ord int, value double, run string")
    got = {h: select.select(df, how=h).first()["value"] for h in select.HOW}
    assert got == {"first": 3.0, "last": 3.0, "min": 1.0, "max": 3.0}
    s = select.summary(df, [], ident="ord").first()
    assert (s["min_id"], s["max_id"], s["count"]) == (2, 1, 5)  # ties go to the earliest
    assert sorted(tuple(r) for r in select.select(df, how="last", per=["run"]).collect()) == [("a", 1.0, 2), ("b", 3.0, 3)]


def test_current_and_reasoning(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "claim_id string, seq int")
    assert sorted((r["seq"], r["superseded_by"]) for r in verdict.current(df).collect()) == [(1, 2), (2, None), (3, None)]
    claims = spark.createDataFrame([("c", "loss", 2.0, None, None, None, False, "2.0", None, None)], CLAIM.rsplit(", ", 3)[0])
    out = verdict.compare(claims, spark.createDataFrame([("c", 2.5)], "claim_id string, value double"))
    said = out.select(verdict.reasoning()).first()[0]
    assert said[0] == "Claimed: loss 2." and "That is worse than claimed." in said
