"""Recipes: what to run for a paper's claim, and the rules that a usable one keeps."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a claim may come from, and verdicts. ----------------------------------------------------------
CLAIM_SOURCES = ["readme", "paper", "manual"]
VERDICTS = ["reproduced", "close", "not_reproduced", "inconclusive", "reimplemented", "could_not_run"]
# ------------------------------------------------------------------------------------------------------------------
SLUG = r"^[a-z0-9][a-z0-9-]*$"
SHA = r"^[0-9a-f]{40}$"


def _rules(r: dict[str, Any]) -> list[tuple[bool, str]]:
    """(holds, what to say if not) of every rule, in the recipe's order."""
    text = lambda v: isinstance(v, str)
    texts = lambda v: isinstance(v, list) and all(map(text, v))
    number = lambda v: isinstance(v, int | float)
    env = r.get("env") or {}
    env_ok = isinstance(env, dict)
    env = env if env_ok else {}
    command, seeds, claim, metric = r.get("command"), r.get("seeds"), r.get("claim"), r.get("metric")
    many_seeds = isinstance(seeds, list) and bool(seeds) and all(isinstance(s, int) for s in seeds)
    rules = [(text(r.get(k)), f"{k} must be a string") for k in ("slug", "title", "area", "repo")]
    rules += [
        (not text(r.get("slug")) or bool(re.match(SLUG, r["slug"])), "slug must be lowercase letters, digits and hyphens"),
        (r.get("commit") is None or (text(r["commit"]) and bool(re.match(SHA, r["commit"]))), "commit must be a full SHA"),
        (r.get("arxiv") is None or bool(re.fullmatch(r"\d{4}\.\d{4,5}", str(r["arxiv"]))), "arxiv must be an arXiv id"),
        (r.get("python") is None or bool(re.fullmatch(r"3\.\d+", str(r["python"]))), "python must be a 3.x version"),
        (env_ok, "env must be a mapping"),
        *((k not in env or texts(env[k]), f"env.{k} must be a list of strings") for k in ("requirements", "extra")),
        *((k not in env or isinstance(env[k], bool), f"env.{k} must be true or false") for k in ("from_readme", "unpin", "install_project", "no_deps_file")),
        (texts(r.get("setup") or []), "setup must be a list of commands"),
        (text(command), "command must be a string"),
        (seeds is None or many_seeds, "seeds must be a non-empty list of integers"),
        (not (many_seeds and text(command)) or "{seed}" in command or len(seeds) == 1, "several seeds need {seed} in the command"),
        (seeds is not None or not text(command) or "{seed}" not in command, "the command uses {seed} but no seeds are listed"),
        (r.get("env_vars") is None or (isinstance(r["env_vars"], dict) and all(text(k) and text(v) for k, v in r["env_vars"].items())), "env_vars must map names to strings"),
        ("timeout" not in r or number(r["timeout"]), "timeout must be a number of seconds"),
        ("authored" not in r or isinstance(r["authored"], bool), "authored must be true or false"),
        (isinstance(metric, dict) and text(metric.get("name")), "metric.name must be a string"),
        (not isinstance(metric, dict) or metric.get("select", "last") in ("last", "first", "min", "max"), "metric.select must be last, first, min or max"),
        (isinstance(claim, dict), "claim must be a mapping"),
    ]
    if isinstance(claim, dict):
        source, span = claim.get("source"), claim.get("range")
        rules += [
            (source in CLAIM_SOURCES, "claim.source must be readme, paper or manual"),
            (number(claim.get("value")) or (isinstance(span, list) and len(span) == 2), "claim needs a value or a range of two numbers"),
            (source != "paper" or bool(r.get("arxiv") or claim.get("arxiv")), "a paper claim needs the arXiv id"),
            *((source != "manual" or text(claim.get(k)), f"a manual claim needs claim.{k}") for k in ("metric", "where", "text")),
        ]
    tol, vetted = r.get("tolerance"), r.get("vetted")
    has_tol = isinstance(tol, dict) and bool({"abs", "rel"} & set(tol))
    rules += [(tol is None or has_tol, "tolerance needs abs or rel"), (tol is None or not has_tol or text(tol.get("why")), "tolerance.why must say why")]
    rules.append((vetted is None or isinstance(vetted, dict), "vetted must be a mapping"))
    if isinstance(vetted, dict):
        rules.append((vetted.get("verdict") in VERDICTS, "vetted.verdict must be a verdict"))
        rules += [(text(vetted.get(k)), f"vetted.{k} must be a string") for k in ("date", "host", "version")]
    return rules


def problems_of(recipe: dict[str, Any]) -> list[str]:
    return [said for holds, said in _rules(recipe) if not holds]


def problems(slug: Column, repo: Column, commit: Column, command: Column, seeds: Column, value: Column, lo: Column, hi: Column) -> Column:
    """The rules over typed recipe columns, as a list of sentences."""
    rule = lambda holds, said: F.when(~F.coalesce(holds, F.lit(False)), said)
    uses = F.contains(command, F.lit("{seed}"))
    n = F.coalesce(F.size(seeds), F.lit(0))
    return F.array_compact(F.array(
        rule(slug.rlike(SLUG), "slug must be lowercase letters, digits and hyphens"),
        rule(repo.isNotNull(), "repo must be a string"),
        rule(commit.isNull() | commit.rlike(SHA), "commit must be a full SHA"),
        rule(command.isNotNull(), "command must be a string"),
        rule((n <= 1) | uses, "several seeds need {seed} in the command"),
        rule((n > 0) | ~uses, "the command uses {seed} but no seeds are listed"),
        rule(value.isNotNull() | (lo.isNotNull() & hi.isNotNull()), "claim needs a value or a range of two numbers"),
    ))


def vetted_summary(comparisons: DataFrame, key: str) -> DataFrame:
    """What a recipe's check found: its verdict, mean, spread and runs, from the current comparison."""
    last = comparisons.groupBy(key).agg(F.max_by(F.struct("verdict", "mean", "std", "n"), "seq").alias("c"))
    return last.select(key, "c.*")
