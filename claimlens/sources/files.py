"""Sources: result files by suffix, snapshots of a checkout, word-box pages, recipes, run outputs."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.extract import csv_values, json_values, lines, text_values
from ..operators.inventory import suffix

# Size limits and suffixes. --------------------------------------------------------------------------
MAX_FILE = 5 * 2**20
STRUCTURED = [".json", ".csv", ".tsv", ".jsonl"]
TEXT = [".txt", ".log", ".out", ".md"]
CAPTURE_STRUCTURED, CAPTURE_TEXT, MAX_CAPTURED = 2 * 2**20, 256 * 2**10, 20
MAX_SNAPSHOT, MAX_LISTED, HASH_LIMIT, MAX_WALK = 200_000, 500, 50 * 2**20, 50_000
SKIP_FOLDERS = [
    ".git", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", "node_modules",
    ".ipynb_checkpoints", ".tox",
]
# ------------------------------------------------------------------------------------------------------------------
WORD_BOX = (
    "doc string, page int, width double, height double, words array<array<string>>, rules array<array<double>>, "
    "hrules array<array<double>>, source string"
)


def decoded(content: Column) -> Column:
    """Bytes as text; those that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def read_files(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """path, size, text of all files below a folder that are not in a skipped one; large files have no text.

    The size test is pushed down to the source, so the content of files over the limit is never read. Bytes that are no
    UTF-8 become replacement characters.
    """
    skipped = "|".join(x.replace(".", r"\.") for x in SKIP_FOLDERS)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    raw = raw.filter(~F.col("path").rlike(rf"/(?:{skipped})/"))
    size = F.col("length").alias("size")
    small = raw.filter(F.col("length") <= MAX_FILE).select("path", size, decoded(F.col("content")).alias("text"))
    return small.unionByName(raw.filter(F.col("length") > MAX_FILE).select("path", size, F.lit(None).cast("string").alias("text")))


def metric_values(files: DataFrame) -> DataFrame:
    """Values of files (path, size, text) by suffix: JSON and JSON lines, delimited tables, else text lines.

    Files over 5 MiB give no rows. The result has the columns of text values with ``row``.
    """
    small = files.filter((F.col("size") <= MAX_FILE) & F.col("text").isNotNull()).select(F.col("path").alias("source"), "text")
    kind = suffix(F.col("source"))
    null = F.lit(None).cast("string")
    parts = [
        json_values(small.filter(kind.isin(".json", ".jsonl"))).withColumns({"fraction": null, "row": null}),
        csv_values(small.filter(kind == ".csv")).withColumn("fraction", null),
        csv_values(small.filter(kind == ".tsv"), separator="\t").withColumn("fraction", null),
        text_values(lines(small.filter(~kind.isin(*STRUCTURED)))).withColumn("row", null),
    ]
    names = ["source", "name", "raw_name", "value", "raw", "percent", "line", "text", "fraction", "row"]
    return reduce(DataFrame.unionByName, [p.select(*names, F.to_json("ord").alias("ord")) for p in parts])


def attribute_runs(values: DataFrame, written: DataFrame) -> DataFrame:
    """Values with the first run (smallest ord) that wrote their file; written: run, path, ord."""
    first = written.groupBy("path").agg(F.min_by("run", "ord").alias("run"))
    return values.join(first, values["source"] == first["path"], "left").drop("path")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", state: list[str] | None = None) -> DataFrame:
    """created, modified and deleted paths between two snapshots (path, and the columns ``state``)."""
    state = state or ["size", "mtime"]
    b = before.select(F.col(key).alias("_k"), F.struct(*state).alias("_old"))
    a = after.select(key, F.struct(*state).alias("_new"))
    both = b.join(a, F.col("_k") == F.col(key), "full")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return both.select(F.coalesce(key, "_k").alias(key), change.alias("change")).filter("change is not null")


def captured(written: DataFrame, key: str) -> DataFrame:
    """Of the files a run wrote (key, path, size): the first 20 small result files by path."""
    kind = suffix(F.col("path"))
    small = (kind.isin(*STRUCTURED) & (F.col("size") <= CAPTURE_STRUCTURED)) | (kind.isin(*TEXT) & (F.col("size") <= CAPTURE_TEXT))
    n = F.row_number().over(Window.partitionBy(key).orderBy("path"))
    return written.filter(small).withColumn("n", n).filter(F.col("n") <= MAX_CAPTURED).drop("n")


def run_outputs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """The texts of each run's stdout, stderr and captured copies, in this order: runs (run, outputs array of paths)."""
    wanted = runs.select("run", F.posexplode("outputs").alias("ord", "path"))
    return wanted.join(files, "path").select("run", "ord", "path", "size", "text")


def word_pages(spark: SparkSession, path: str) -> DataFrame:
    """Word-box pages in JSON, words and rules as structs."""
    raw = spark.read.schema(WORD_BOX).option("multiLine", True).json(path)
    return shape_pages(raw.withColumn("doc", F.coalesce("doc", "source")))


def shape_pages(raw: DataFrame) -> DataFrame:
    """List-form words and rules -> arrays of structs."""
    d = lambda w, k: w[k].cast("double")
    words = F.transform("words", lambda w: F.struct(d(w, 0).alias("x0"), d(w, 1).alias("x1"), d(w, 2).alias("top"), d(w, 3).alias("bottom"), d(w, 4).alias("size"), w[5].alias("text")))
    rules = F.transform("rules", lambda r: F.struct(r[0].alias("x"), r[1].alias("top"), r[2].alias("bottom")))
    hrules = F.transform("hrules", lambda r: F.struct(r[0].alias("y"), r[1].alias("x0"), r[2].alias("x1")))
    return raw.select("doc", "page", "width", "height", words.alias("words"), rules.alias("rules"), hrules.alias("hrules"))


def read_recipes(spark: SparkSession, text: str) -> DataFrame:
    """A list of recipes in YAML, as (ord, recipe VARIANT); any problem of any recipe fails the load."""
    import yaml

    from ..operators.recipes import problems_of

    recipes = yaml.safe_load(text) or []
    bad = [f"{r.get('slug', k)}: {p}" for k, r in enumerate(recipes) for p in problems_of(r)]
    if bad:
        raise ValueError("; ".join(bad))
    rows = [(k, json.dumps(r, default=str)) for k, r in enumerate(recipes)]
    return spark.createDataFrame(rows, "ord int, body string").select("ord", F.parse_json("body").alias("recipe"))


def glue_numbers(page: DataFrame, text: str = "text") -> DataFrame:
    """Page text in compatibility form (NFKC), split decimals (59 .5) mended, plus-minus signs spaced."""
    @F.pandas_udf("string")
    def compatible(t: pd.Series) -> pd.Series:
        return t.str.normalize("NFKC")

    t = F.regexp_replace(compatible(F.col(text)), r"(\d) \.(\d)", "$1.$2")
    return page.withColumn(text, F.replace(F.regexp_replace(t, r"(\d)\s*±\s*(\d)", "$1 ± $2"), F.lit("\u00a0"), F.lit(" ")))
