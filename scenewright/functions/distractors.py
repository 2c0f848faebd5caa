"""Candidate wrong answers as expressions, and the composition of options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import RELATIONS
from ..rng import order_key


def numeric(count: Column, k: int) -> Column:
    """The k whole numbers nearest to the count, the larger first, none negative."""
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda o: F.array(count + o, count - o)))
    return F.slice(F.filter(steps, lambda x: x >= 0), 1, k)


def other_counts(count: Column, scene_counts: Column) -> Column:
    """Other counts of the scene and the neighbours of the count up to two away, sorted."""
    near = F.filter(F.array(count - 2, count - 1, count + 1, count + 2), lambda x: x >= 0)
    return F.array_sort(F.array_distinct(F.filter(F.concat(scene_counts, near), lambda x: x != count)))


def relations(answer: Column) -> Column:
    """The thirteen other relations, sorted."""
    return F.array_sort(F.array_remove(F.array(*map(F.lit, RELATIONS)), answer))


def ranked(values: Column, *key) -> Column:
    """The distinct values in a random order that depends on the key only."""
    keyed = F.transform(F.array_distinct(values), lambda v: F.struct(order_key(*key, v).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def with_options(rows: DataFrame, answer: str, candidates: str, options: int, *key) -> DataFrame:
    """The rows with ``options``: the answer and ``options`` - 1 of the candidates, in random order; rows with too few are left out."""
    wrong = F.slice(ranked(F.filter(candidates, lambda c: c != F.col(answer)), *key, "pick"), 1, options - 1)
    chosen = rows.withColumn("chosen_", wrong).filter(F.size("chosen_") == options - 1)
    return chosen.withColumn("options", ranked(F.concat("chosen_", F.array(answer)), *key, "mix")).drop("chosen_")
