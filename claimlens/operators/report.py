"""Reports over the evidence: counts, what was not checked, deviations, badges, status, assembled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE_KINDS = ["observation", "deviation", "not_checked", "blocker"]
#: Badge colours by verdict.
COLORS = {"reproduced": "1f7a3a", "close": "a15c00", "not_reproduced": "b42318", "reimplemented": "5b3fa8", "inconclusive": "475467", "could_not_run": "475467"}
NO_COLOR = "475467"


def verdict_counts(comparisons: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """How many current comparisons have each label."""
    rows = comparisons.filter("superseded_by is null") if "superseded_by" in comparisons.columns else comparisons
    return rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def overall(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One sentence per key: how many claims were compared, and with which labels."""
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "label", "n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["n"], F.lower(p["label"]))), ", ")
    return counts.groupBy(*keys).agg(F.concat(F.sum("n").cast("string"), F.lit(" claims compared: "), text, F.lit(".")).alias("overall"))


def command_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs, runs that ended well, total seconds, and seconds of full and smoke runs."""
    counted = F.col("scope").isin("full", "smoke")
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_run"), F.count(F.when(F.col("exit_code") == 0, 1)).alias("n_ok"), F.sum("wall_seconds").alias("seconds"), F.coalesce(F.sum(F.when(counted, F.col("wall_seconds"))), F.lit(0.0)).alias("run_seconds"))


def not_compared(claims: DataFrame, comparisons: DataFrame, key: str, samples: int = 6) -> DataFrame:
    """Claims that no comparison names: their number and the first few by ord."""
    open_claims = claims.join(comparisons.select("claim_id").distinct(), "claim_id", "left_anti")
    # a bounded sample per key: the n smallest are kept while aggregating, never the whole group
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ord")
    first = open_claims.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= samples)
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "claim_id"))), lambda x: x["claim_id"]).alias("sample"))
    return open_claims.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(lists, key)


def not_checked(claims: DataFrame, comparisons: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Everything that the study leaves open, as (key, rank, text)."""
    rest = not_compared(claims, comparisons, key)
    more = F.when(F.col("n") > 6, F.concat(F.lit(" and "), (F.col("n") - 6).cast("string"), F.lit(" more"))).otherwise("")
    a = rest.select(key, F.lit(0).alias("rank"), F.concat(F.col("n").cast("string"), F.lit(" numbers were not compared: "), F.concat_ws(", ", "sample"), more).alias("text"))
    b = comparisons.filter("shortened").select(key, F.lit(1).alias("rank"), F.concat(F.col("claim_id"), F.lit(" was measured on a shortened run only")).alias("text"))
    c = comparisons.filter("n = 1").select(key, F.lit(2).alias("rank"), F.concat(F.col("claim_id"), F.lit(" was measured once")).alias("text"))
    d = notes.filter("note_kind = 'not_checked'").select(key, F.lit(3).alias("rank"), "text")
    return a.unionByName(b).unionByName(c).unionByName(d)


def deviations(envs: DataFrame, runs: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Deviations of environments, shortened runs and notes, in this order."""
    a = envs.select(key, F.lit(0).alias("rank"), "seq", F.explode("deviations").alias("text"))
    b = runs.filter("scope = 'shortened'").select(key, F.lit(1).alias("rank"), "seq", F.concat(F.col("id"), F.lit(": "), F.coalesce("note", F.lit("shortened"))).alias("text"))
    c = notes.filter("note_kind = 'deviation'").select(key, F.lit(2).alias("rank"), "seq", "text")
    return a.unionByName(b).unionByName(c)


def add_notes(notes: DataFrame) -> DataFrame:
    """Notes of a known kind with some text; any other row fails."""
    good = F.col("note_kind").isin(NOTE_KINDS) & (F.trim("text") != "")
    return notes.withColumn("text", F.when(good, F.col("text")).otherwise(F.raise_error(F.lit("a note needs a known kind and a text")).cast("string")))


def badge_part(text: Column) -> Column:
    """Percent-encoded for a badge path, - and _ doubled."""
    doubled = F.replace(F.replace(text, F.lit("-"), F.lit("--")), F.lit("_"), F.lit("__"))
    out = F.replace(F.replace(F.url_encode(doubled), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def badge_url(name: Column, label: Column, measured: Column, claimed: Column, verdict: Column) -> Column:
    message = F.when(measured.isNull(), label).otherwise(F.concat(label, F.lit(" "), measured, F.lit(" vs "), claimed))
    color = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv]), verdict), F.lit(NO_COLOR))
    return F.concat(F.lit("https://img.shields.io/badge/"), badge_part(name), F.lit("-"), badge_part(message), F.lit("-"), color)


def metric_status(values: DataFrame, keys: list[str], limit: int = 30) -> DataFrame:
    """Values and the first distinct names of each extraction."""
    names = F.slice(F.array_sort(F.collect_set("name")), 1, limit)
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), names.alias("names"))


def assemble(claims: DataFrame, comparisons: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """One JSON document per study; a study's state is bounded by what one report shows."""

    def part(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    out = part(claims, "claims").join(part(comparisons, "comparisons"), key, "full").join(part(notes, "notes"), key, "full")
    return out.select(key, F.to_json(F.struct("claims", "comparisons", "notes")).alias("report"))


def tables_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuilt tables (keys, row_index, label, group, column_index, column, value) as pipe tables."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))
    label = F.when(F.col("group").isNotNull(), F.concat(safe(F.col("label")), F.lit(" ("), safe(F.col("group")), F.lit(")"))).otherwise(safe(F.col("label")))
    rows = cells.groupBy(*keys, "row_index").agg(F.first(label).alias("l"), F.array_sort(F.collect_list(F.struct("column_index", safe(F.col("column")).alias("c"), safe(F.col("value")).alias("v")))).alias("cs"))
    bar = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |"))
    line = bar(F.concat(F.array("l"), F.transform("cs", lambda x: x["v"])))
    head = bar(F.concat(F.array(F.lit("")), F.transform("cs", lambda x: x["c"])))
    rule = bar(F.array_repeat(F.lit("---"), F.size("cs") + 1))
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(head.alias("h"), rule.alias("r")), "row_index").alias("t"), F.array_sort(F.collect_list(F.struct("row_index", line.alias("line")))).alias("ls"))
    return out.select(*keys, F.concat_ws("\n", "t.h", "t.r", F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("markdown"))


def markdown(comparisons: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """A report per study: a table of its current comparisons and what was not checked."""
    safe = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", safe("claim_id"), safe("label"), safe("headline")), F.lit(" |"))
    table = comparisons.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", row.alias("r")))), lambda x: x["r"]), "\n").alias("t"))
    rest = checks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("c"))
    parts = [F.lit("| Claim | Verdict | Summary |\n|---|---|---|"), F.col("t"), F.lit("\n## Not checked\n"), F.coalesce("c", F.lit("- nothing"))]
    return table.join(rest, key, "left").select(key, F.concat_ws("\n", *parts).alias("report"))


def gallery_table(recipes: DataFrame, vetted: DataFrame, key: str) -> DataFrame:
    """A line per recipe with what its check found, in the recipes' order."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rows = recipes.join(vetted, key, "left")
    return rows.select(key, "ord", F.concat(F.lit("| "), F.concat_ws(" | ", F.col(key), cell("title"), cell("verdict"), cell("mean")), F.lit(" |")).alias("line"))
