"""Summaries of metric values, and selectors over them: first, last, min, max, of all runs or of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_metric

HOW = ("last", "first", "min", "max")


def _pick(how: str, field: str, value: str, order: str) -> Column:
    """The field of the chosen row; ties go to the earliest."""
    tie = F.struct(F.col(value).alias("v"), F.col(order).alias("o"))
    down = F.struct((-F.col(value)).alias("v"), F.col(order).alias("o"))
    return {"first": F.min_by(field, order), "last": F.max_by(field, order), "min": F.min_by(field, tie), "max": F.min_by(field, down)}[how]


def summary(values: DataFrame, keys: list[str], *, value: str = "value", order: str = "ord", ident: str | None = None) -> DataFrame:
    """Count, first, last, min and max by key, each with the id of its row when ``ident`` names one."""
    aggs = [F.count(F.lit(1)).alias("count")]
    for how in HOW:
        aggs.append(_pick(how, value, value, order).alias(how))
        if ident:
            aggs.append(_pick(how, ident, value, order).alias(f"{how}_id"))
    return values.groupBy(*keys).agg(*aggs)


def select(values: DataFrame, name: str | None = None, how: str = "last", *, per: list[str] | None = None, value: str = "value", order: str = "ord") -> DataFrame:
    """The chosen value of a metric; ``per`` (such as the run) gives one for each of its groups."""
    if how not in HOW:
        raise ValueError(f"unknown choice {how!r}; one of {', '.join(HOW)}")
    if name is not None:
        values = values.filter(F.col("name") == name)
    return values.groupBy(*(per or [])).agg(_pick(how, value, value, order).alias("value"), F.count(F.lit(1)).alias("n"))


def run_stats(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, sample standard deviation (null for one value), min and max."""
    v = F.col(value)
    return values.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def selectors(rows: DataFrame, text: str = "selector") -> DataFrame:
    """``rows`` with what their selectors say: extraction, id, name, how, run (each for one of every run); all null for a bad one.

    A selector is an id, m2.17, or a name, m2:name[:how][@run|@each].
    """
    sel = F.trim(text)
    run = F.when(F.contains(sel, F.lit(":")), F.nullif(F.regexp_extract(sel, "@(r[^@]*|each)$", 1), F.lit("")))
    plain = F.when(run.isNotNull(), F.regexp_replace(sel, "@[^@]*$", "")).otherwise(sel)
    found = lambda pattern, k: F.nullif(F.regexp_extract(plain, pattern, k), F.lit(""))
    by_id, by_name = r"^(m\d+)\.\d+$", r"^(m\d+):([^:]+?)(?::(last|first|min|max))?$"
    name = found(by_name, 2)
    fields = {
        "extraction": F.coalesce(found(by_id, 1), found(by_name, 1)), "id": F.when(plain.rlike(by_id), plain), "name": normalize_metric(name),
        "how": F.when(name.isNotNull(), F.coalesce(found(by_name, 3), F.lit("last"))), "run": F.when(name.isNotNull(), run),
    }
    return rows.withColumns(fields)


def resolve(values: DataFrame, wanted: DataFrame, shown: int = 20) -> DataFrame:
    """selector, run, id, value, n, problem: what each selector of ``wanted`` (selector) stands for among the values.

    values: extraction, id, name, run, value, ord. Values are first aggregated by extraction, name and run, so a selector meets a row
    for each run, not one for each value. A selector @each has a row for every run; one that finds nothing has a row with
    the reason, which names up to ``shown`` metrics that there are.
    """
    sel = selectors(wanted.select("selector").distinct())
    place = lambda *first: F.struct(*first, "ord", "id", "value")
    picks = {"first": F.min(place()), "last": F.max(place()), "min": F.min(place(F.col("value").alias("by"))), "max": F.min(place((-F.col("value")).alias("by")))}
    runs = values.groupBy("extraction", "name", "run").agg(F.count(F.lit(1)).alias("n"), *[c.alias(how) for how, c in picks.items()])
    named = sel.filter("name is not null").join(runs.withColumnsRenamed({"run": "of_run"}), ["extraction", "name"])
    named = named.filter(F.col("run").isNull() | (F.col("run") == "each") | (F.col("run") == F.col("of_run")))
    again = [(F.max if how == "last" else F.min)(how).alias(how) for how in picks]
    named = named.groupBy("selector", "how", F.when(F.col("run") == "each", F.col("of_run")).otherwise(F.col("run")).alias("run")).agg(F.sum("n").alias("n"), *again)
    of = lambda field: F.coalesce(*[F.when(F.col("how") == how, F.col(how)[field]) for how in picks]).alias(field)
    named = named.select("selector", "run", of("id"), of("value"), "n")
    one = sel.filter("id is not null").join(values.select("extraction", "id", "value"), ["extraction", "id"])
    found = named.unionByName(one.select("selector", F.lit(None).cast("string").alias("run"), "id", "value", F.lit(1).cast("long").alias("n")))

    names = values.groupBy("extraction", "name").count().groupBy("extraction").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rest = sel.join(found.select("selector").distinct(), "selector", "left_anti").join(names, "extraction", "left")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    problem = F.when(F.col("extraction").isNull(), F.concat(F.lit("Bad selector "), quoted(F.col("selector")))).when(F.col("names").isNull(), F.concat(F.lit("Unknown metrics extraction "), quoted(F.col("extraction"))))
    problem = problem.when(F.col("id").isNotNull(), F.concat(F.lit("No value "), quoted(F.col("id")), F.lit(" in "), F.col("extraction")))
    listed = F.array_join(F.slice("names", 1, shown), ", ")
    problem = problem.otherwise(F.concat(F.lit("No "), quoted(F.col("name")), F.lit(" values in "), F.col("extraction"), F.lit(". Names found: "), listed))
    return found.withColumn("problem", F.lit(None).cast("string")).unionByName(rest.select("selector", "run", F.lit(0).cast("long").alias("n"), problem.alias("problem")), allowMissingColumns=True)
