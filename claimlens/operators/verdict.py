"""Claims against measurements: target interval, scale, tolerance, distance, verdict and label, as column expressions.

A claim row has claim_id, metric (normalised), value, lo, hi, plus_minus, percent and the texts value_text, lo_text,
hi_text; a measurement row has claim_id, value, percent and optionally run, scope, origin, unsourced, name. ``compare``
aggregates the measurements of each claim (one shuffle on claim_id) and adds the verdict's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import decimals, is_ratio, lower_is_better, same_quantity
from ..functions.text import compact_number

# Default tolerance, close band, slack, labels, reasons and the patterns of errors. -----------------
RELATIVE = 0.01
CLOSE_FACTOR = 3.0
SLACK = 1e-12
LABELS = {
    "reproduced": "REPRODUCED",
    "close": "PARTIAL",
    "not_reproduced": "NOT REPRODUCED",
    "inconclusive": "INCONCLUSIVE",
    "reimplemented": "REIMPLEMENTED",
    "could_not_run": "COULD NOT RUN",
}
ALONE = {"reproduced": "numbers match", "close": "numbers close", "not_reproduced": "numbers differ"}
REASONS = {
    "gpu_required": "GPU required",
    "data_unavailable": "data unavailable",
    "broken_deps": "dependencies do not install",
    "no_command": "no command that produces the number",
    "timeout": "time limit reached",
    "no_metric": "the run printed no number to compare",
    "run_failed": "the run failed",
    "other": "see the blocking error",
}
GPU_ERROR = (
    r"(?i)Torch not compiled with CUDA|no CUDA GPUs|CUDA driver|cudaGetDevice|nvidia-smi|libcuda|NVIDIA driver|"
    r"requires a GPU|CUDA_HOME|cuda\.is_available\(\) is False|Found no NVIDIA|No CUDA runtime|CUDA error|device-side|"
    r"cupy|triton"
)
DATA_ERROR = (
    r"(?i)HTTP Error 4\d\d|404 Not Found|403 Forbidden|urlopen error|Name or service not known|nodename nor servname|"
    r"ConnectionError|Max retries exceeded|Dataset not found|requires you to accept|gated repo|"
    r"Unrecognized archive format|not in gzip format|"
    r"(?:FileNotFoundError|No such file or directory)[^\n]*(?:data|\.csv|\.np[yz]|\.pkl|\.pt|\.h5|\.json|\.txt|\.bin|\.zip|\.tar)|"
    r"(?:data|\.csv|\.np[yz]|\.pkl|\.h5|\.zip|\.tar)[^\s:]*: No such file or directory"
)
# ------------------------------------------------------------------------------------------------------------------


def target() -> dict[str, Column]:
    """t_lo, t_hi and t_mid: the interval that a measurement should land in, before tolerance."""
    ranged = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    pm = F.coalesce(F.col("plus_minus"), F.lit(0.0))
    lo = F.when(ranged, F.least("lo", "hi")).otherwise(F.col("value") - pm)
    hi = F.when(ranged, F.greatest("lo", "hi")).otherwise(F.col("value") + pm)
    return {"t_lo": lo, "t_hi": hi, "t_mid": (lo + hi) / 2}


def in_percent() -> Column:
    """Whether the claim is on a 0 to 100 scale: said so, or a ratio metric over 1."""
    hi = F.col("t_hi")
    return F.coalesce(F.col("percent"), F.lit(False)) | (is_ratio(F.col("metric")) & (hi > 1) & (hi <= 100))


def rescaled(value: Column, percent: Column) -> Column:
    """The measured value on the claim's scale (t_hi and claim_pct are at hand)."""
    up = F.col("claim_pct") & ~percent & (F.abs(value) <= 1)
    down = ~F.col("claim_pct") & percent & (F.col("t_hi") <= 1)
    return F.when(up, value * 100).when(down, value / 100).otherwise(value)


def tolerance(tol: Column | None = None, rel: Column | None = None) -> Column:
    """Absolute, or relative to the target's middle, and never below half a unit of the claim's last written digit."""
    relative = (F.abs(rel) if rel is not None else F.lit(RELATIVE)) * F.abs(F.col("t_mid"))
    base = F.coalesce(F.abs(tol), relative) if tol is not None else relative
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    written = F.coalesce(empty("value_text"), empty("hi_text"), empty("lo_text"))
    half = F.coalesce(F.lit(0.5) * F.pow(F.lit(10.0), -decimals(written)), F.lit(0.0))
    return F.greatest(base, half)


def close_band(close: Column | None = None, close_rel: Column | None = None) -> Column:
    out = F.lit(CLOSE_FACTOR) * F.col("tol_abs")
    if close_rel is not None:
        out = F.coalesce(F.abs(close_rel) * F.abs(F.col("t_mid")), out)
    if close is not None:
        out = F.coalesce(F.abs(close), out)
    return F.greatest(out, F.col("tol_abs"))


def distance() -> Column:
    m = F.col("mean")
    return F.when(m.between(F.col("t_lo"), F.col("t_hi")), 0.0).when(m < F.col("t_lo"), F.col("t_lo") - m).otherwise(m - F.col("t_hi"))


def signed_distance() -> Column:
    m = F.col("mean")
    to_range = F.when(m < F.col("t_lo"), m - F.col("t_lo")).when(m > F.col("t_hi"), m - F.col("t_hi")).otherwise(0.0)
    return F.when(F.col("t_lo") == F.col("t_hi"), m - F.col("t_mid")).otherwise(to_range)


def band() -> Column:
    finite = ~F.isnan("mean") & (F.abs("mean") != float("inf"))
    near = F.when(F.col("distance") <= F.col("tol_abs") + SLACK, "reproduced").when(F.col("distance") <= F.col("close_abs") + SLACK, "close")
    return F.when(finite, near.otherwise("not_reproduced")).otherwise("not_reproduced")


def final_verdict() -> Column:
    """Shortened runs decide nothing; commands written for the study check a reimplementation only."""
    return F.when(F.col("shortened"), "inconclusive").when(F.col("authored"), "reimplemented").otherwise(F.col("band"))


def label(verdict: Column, alone: Column, reason: Column, smoke: Column) -> Column:
    pick = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    name = F.coalesce(pick(LABELS, verdict), F.upper(verdict))
    inner = F.when(verdict == "reimplemented", pick(ALONE, alone)).when(verdict == "could_not_run", pick(REASONS, reason))
    inner = F.when(verdict == "inconclusive", F.when(smoke, "reduced-scale smoke check").otherwise("shortened run")).otherwise(inner)
    return F.when(inner.isNull(), name).otherwise(F.concat(name, F.lit(" ("), inner, F.lit(")")))


def compare(claims: DataFrame, measured: DataFrame, *, tol: str | None = None, rel: str | None = None, close: str | None = None, close_rel: str | None = None) -> DataFrame:
    """One row per claim with measurements; ``tol`` and so on name columns of ``claims`` that set a tolerance where not null.

    The claims are joined to their measurements once; a claim's options ride along.
    """
    have = set(measured.columns)
    flag = lambda c: F.coalesce(F.col(f"m_{c}"), F.lit(False)) if c in have else F.lit(False)
    m = measured.select("claim_id", *[F.col(c).alias(f"m_{c}") for c in measured.columns if c != "claim_id"])
    c = claims.withColumns(target()).withColumn("claim_pct", in_percent())
    rows = c.join(m, "claim_id").withColumn("scaled", rescaled(F.col("m_value"), flag("percent")))
    scope = F.col("m_scope") if "scope" in have else F.lit(None).cast("string")
    origin = F.col("m_origin") if "origin" in have else F.lit(None).cast("string")
    run = F.col("m_run") if "run" in have else F.lit(None).cast("string")
    same = same_quantity(F.col("metric"), F.col("m_name")) if "name" in have else F.lit(True)
    v = F.col("scaled")
    stats = rows.groupBy("claim_id").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.bool_or(scope.isin("shortened", "smoke")), F.lit(False)).alias("shortened"),
        F.coalesce(F.bool_or(scope == "smoke"), F.lit(False)).alias("smoke"),
        F.coalesce(F.bool_or(origin == "authored"), F.lit(False)).alias("authored"),
        F.bool_or(flag("unsourced")).alias("unsourced"),
        (F.count(run) > F.count_distinct(run)).alias("same_run_twice"),
        F.coalesce(F.bool_and(same), F.lit(True)).alias("same_name"),
    )
    opt = lambda name: F.col(name) if name else None
    out = c.join(stats, "claim_id").withColumn("tol_abs", tolerance(opt(tol), opt(rel)))
    out = out.withColumn("close_abs", close_band(opt(close), opt(close_rel))).withColumn("distance", distance())
    out = out.withColumn("signed_difference", signed_distance()).withColumn("band", band()).withColumn("verdict", final_verdict())
    overridden = F.col("verdict").isin("inconclusive", "reimplemented")
    out = out.withColumn("numbers_alone", F.when(overridden, F.col("band")))
    out = out.withColumn("counts_as_reproduction", (F.col("band") == "reproduced") & ~F.col("shortened") & ~F.col("unsourced") & ~F.col("authored"))
    worse = F.when(F.col("signed_difference") == 0, None).when((F.col("signed_difference") < 0) == lower_is_better(F.col("metric")), "better").otherwise("worse")
    out = out.withColumn("direction", worse)
    return out.withColumn("label", label(F.col("verdict"), F.col("numbers_alone"), F.lit(None).cast("string"), F.col("smoke")))


def reasoning() -> Column:
    """The sentences that explain a row of ``compare``, in order."""
    num = compact_number
    ranged = F.col("t_lo") != F.col("t_hi")
    unit = F.when(F.col("claim_pct"), F.lit("%")).otherwise(F.lit(""))
    aim = F.when(ranged, F.concat(F.lit("the range "), num(F.col("t_lo")), unit, F.lit(" to "), num(F.col("t_hi")), unit)).otherwise(F.concat(num(F.col("t_mid")), unit))
    many = F.concat(F.lit("Measured over "), F.col("n").cast("string"), F.lit(" runs: mean "), num(F.col("mean")), F.lit(", std "), num(F.col("std")), F.lit(", min "), num(F.col("min")), F.lit(", max "), num(F.col("max")), F.lit("."))
    reached = F.when(ranged, F.lit("The mean lies inside the claimed range.")).otherwise(F.lit("The value is exactly the claimed one."))
    sentences = [
        F.concat(F.lit("Claimed: "), F.col("metric"), F.lit(" "), aim, F.lit(".")),
        F.when(F.col("n") == 1, F.concat(F.lit("Measured once: "), num(F.col("mean")), F.lit("."))).otherwise(many),
        F.when(F.col("distance") == 0, reached).otherwise(F.concat(F.lit("Off by "), num(F.col("distance")), F.lit("."))),
        F.when(F.col("direction").isNotNull(), F.concat(F.lit("That is "), F.col("direction"), F.lit(" than claimed."))),
        F.concat(F.lit("Tolerance "), num(F.col("tol_abs")), F.lit(", close band "), num(F.col("close_abs")), F.lit(".")),
        F.when(F.col("n") == 1, F.lit("One run does not show the variation between runs.")),
        F.when(F.col("std") > F.col("tol_abs"), F.lit("The runs differ by more than the tolerance.")),
        F.when(F.col("same_run_twice"), F.lit("Several values come from one run.")),
        F.when(~F.col("same_name"), F.lit("The measured names may be another quantity.")),
        F.when(F.col("unsourced"), F.lit("A value was typed in by hand.")),
        F.when(F.col("shortened"), F.lit("A shortened run cannot decide the full claim.")),
        F.when(F.col("authored"), F.lit("The command was written for this study.")),
    ]
    return F.array_compact(F.array(*sentences))


def headline() -> Column:
    """One sentence for a row of ``compare``: verdict, claim, measurement and gap."""
    num = compact_number
    unit = F.when(F.col("claim_pct"), F.lit("%")).otherwise(F.lit(""))
    ranged = F.col("t_lo") != F.col("t_hi")
    aim = F.when(ranged, F.concat(num(F.col("t_lo")), unit, F.lit(" to "), num(F.col("t_hi")), unit)).otherwise(F.concat(num(F.col("t_mid")), unit))
    runs = F.when(F.col("n") > 1, F.concat(F.lit(" (mean of "), F.col("n").cast("string"), F.lit(" runs)"))).otherwise(F.lit(""))
    gap = F.when(F.col("distance") == 0, F.when(ranged, F.lit("inside the claimed range")).otherwise(F.lit("an exact match"))).otherwise(F.concat(num(F.col("distance")), F.lit(" away")))
    bound = F.when(F.col("band") == "not_reproduced", F.concat(F.lit("beyond "), num(F.col("close_abs")))).otherwise(F.concat(F.lit("tolerance "), num(F.col("tol_abs"))))
    return F.concat(F.col("label"), F.lit(": "), F.col("metric"), F.lit(" claimed "), aim, F.lit(", measured "), num(F.col("mean")), unit, runs, F.lit(", "), gap, F.lit(" ("), bound, F.lit(")."))


def blocking_reason(kind: Column, error: Column, timed_out: Column) -> Column:
    """Why nothing was measured; kind is env, run or null, error the whole stderr (its last 200,000 characters count)."""
    text = F.coalesce(F.right(error, F.lit(200_000)), F.lit(""))
    out = F.when(kind.isNull(), "other").when(kind == "env", "broken_deps").when(text.rlike(GPU_ERROR), "gpu_required")
    return out.when(F.coalesce(timed_out, F.lit(False)), "timeout").when(text.rlike(DATA_ERROR), "data_unavailable").otherwise("run_failed")


def blocking_step(envs: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The latest failing step (largest seq) of each key: envs (status, error, seq), runs (exit_code, timed_out, error, seq)."""
    cols = [*keys, "id", "kind", "error", "timed_out", "seq"]
    bad_env = envs.filter("status <> 'ok'").withColumn("kind", F.lit("env")).withColumn("timed_out", F.lit(False))
    bad_run = runs.filter("exit_code is null or exit_code <> 0 or timed_out").withColumn("kind", F.lit("run"))
    steps = bad_env.select(*cols).unionByName(bad_run.select(*cols))
    last = steps.groupBy(*keys).agg(F.max_by(F.struct("id", "kind", "error", "timed_out"), "seq").alias("s"))
    s = last.select(*keys, "s.*")
    return s.withColumn("reason", blocking_reason(F.col("kind"), F.col("error"), F.col("timed_out")))


def could_not_run(claims: DataFrame, steps: DataFrame) -> DataFrame:
    """Claims with a blocking step become COULD NOT RUN, with its reason."""
    out = claims.join(steps, "claim_id").withColumn("verdict", F.lit("could_not_run"))
    none = F.lit(None).cast("string")
    return out.withColumn("label", label(F.col("verdict"), none, F.col("reason"), F.lit(False)))


def current(comparisons: DataFrame, claim: str = "claim_id", seq: str = "seq") -> DataFrame:
    """All comparisons with ``superseded_by``, null for the latest of its claim."""
    from pyspark.sql import Window

    later = F.last(seq).over(Window.partitionBy(claim).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return comparisons.withColumn("superseded_by", F.when(F.col(seq) < later, later))


def latest(comparisons: DataFrame, claim: str = "claim_id", seq: str = "seq") -> DataFrame:
    """Only the latest comparison of each claim, by an aggregation that combines before its shuffle."""
    rest = [c for c in comparisons.columns if c != claim]
    return comparisons.groupBy(claim).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(claim, "_r.*")
