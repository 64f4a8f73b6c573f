"""Canonical metric names and number texts, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ALIASES, LOWER_IS_BETTER, RATIO_METRICS, SPLITS, qualifiers, quote
from .text import let, strip


def normalize_metric(name: Column) -> Column:
    """Lower case, underscores, aliases folded part by part, a trailing split moved to the front."""
    n = F.regexp_replace(F.lower(strip(name)), r"[.:]+$", "")
    n = F.regexp_replace(n, r"(?U)[\s\-]+", "_")
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() if "_" not in pair[0] for x in pair])
    parts = F.transform(F.filter(F.split(n, "_", -1), lambda p: p != ""), lambda p: F.coalesce(F.try_element_at(aliases, p), p))

    def ordered(p: Column) -> Column:
        last = F.try_element_at(p, F.lit(-1))
        moved = F.concat(F.array(last), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))
        return F.array_join(F.when((F.size(p) > 1) & last.isin(SPLITS), moved).otherwise(p), "_")

    return F.regexp_replace(let(parts, ordered), r"^top_?([15])(?:_accuracy)?$", "top$1_accuracy")


def metric_base(normal: Column) -> Column:
    """A normalised name without its leading qualifiers; at least one part stays."""
    return F.regexp_replace(normal, rf"^(?:(?:{quote(qualifiers())})_)+", "")


def lower_is_better(normal: Column) -> Column:
    base = metric_base(normal)
    return base.isin(LOWER_IS_BETTER) | F.element_at(F.split(base, "_"), -1).isin(LOWER_IS_BETTER)


def is_ratio(normal: Column) -> Column:
    return normal.isin(RATIO_METRICS) | metric_base(normal).isin(RATIO_METRICS)


def is_result_metric(normal: Column) -> Column:
    """Whether the name is a result that a study reports, and not a setting."""
    known = sorted({*RATIO_METRICS, *LOWER_IS_BETTER})
    words = F.split(metric_base(normal), "_")
    return metric_base(normal).isin(known) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in [*known, "bleu", "rouge", "return", "reward"]]))


def same_quantity(a: Column, b: Column) -> Column:
    last = lambda c: metric_base(normalize_metric(F.element_at(F.split(F.replace(c, F.lit("."), F.lit("_")), "_"), -1)))
    return last(a) == last(b)


def decimals(text: Column) -> Column:
    """Digits behind the point as written; 0 for exponent forms."""
    t = F.regexp_replace(strip(text), r"^[+-]+", "")
    return F.when(F.lower(t).contains("e"), 0).otherwise(F.length(F.regexp_extract(t, r"^[^.]*\.(.*)$", 1)))


def number(text: Column) -> Column:
    return text.try_cast("double")
