"""Model answers, scores and the budgeted selection of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relations import option_labels
from ..rng import order_key
from .numbering import numbered


def resolve_answer(answer: Column, choices: Column) -> Column:
    """The choice that a free answer means, or an empty string.

    In this order: the choice itself, its option "(A) text", its letter, its bracketed letter; else the only one of
    the choices, options, letters or bracketed letters that the answer contains.
    """
    a = F.trim(answer)
    options = option_labels(choices)
    letters = F.transform(choices, lambda c, i: F.char(i + 65))
    brackets = F.transform(choices, lambda c, i: F.concat(F.lit("("), F.char(i + 65), F.lit(")")))
    at = lambda place: F.when(place > 0, F.element_at(choices, place.cast("int")))
    exact = [at(F.array_position(x, a)) for x in (choices, options, letters, brackets)]

    def only(x: Column) -> Column:
        held = F.filter(F.transform(x, lambda o, i: F.when(F.contains(a, o), i + 1)), lambda i: i.isNotNull())
        return F.when(F.size(held) == 1, F.element_at(choices, held[0].cast("int")))

    return F.coalesce(*exact, *[only(x) for x in (choices, options, letters, brackets)], F.lit(""))


#: Tested tasks that are broadcast at once: at 192 numbers each some 15 MB.
HISTORY = 10_000


def utility(candidates: DataFrame, history: DataFrame, weight: float = 0.2, block: int = HISTORY) -> DataFrame:
    """(task_id, utility): the greatest similarity to a failed task less ``weight`` times that to any tested one.

    ``candidates`` has (task_id, embedding), ``history`` (embedding, is_correct); no tested, or failed, task counts as
    similarity 0. A history of up to ``block`` rows is one broadcast matrix. A longer one is cut into blocks by a hash; each gives every
    candidate's two greatest similarities, and these are aggregated, so no matrix is over some times ``block``.
    """
    total = history.count()
    n = max(1, -(-total // block))
    rows = candidates.select(F.col("task_id").cast("long").alias("task_id"), "embedding")
    own = history.select("embedding", "is_correct")
    parts = [own if n == 1 else own.filter(F.pmod(F.xxhash64("embedding"), F.lit(n)) == k) for k in range(n)]
    found = [_similar(rows, part) for part in parts]
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    if n > 1:
        made = made.groupBy("task_id").agg(F.max("failed").alias("failed"), F.max("tested").alias("tested"))
    return made.select("task_id", (F.coalesce("failed", F.lit(0.0)) - weight * F.coalesce("tested", F.lit(0.0))).alias("utility"))


def _similar(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """(task_id, failed, tested): the greatest similarities to a failed and to any task of one block; null without one."""
    rows = history.toArrow()
    matrix = np.array(rows.column("embedding").to_pylist(), float)
    wrong = ~np.array(rows.column("is_correct").to_pylist(), bool)
    shared = candidates.sparkSession.sparkContext.broadcast((matrix, wrong))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bad = shared.value
        for batch in batches:
            failed, tested = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            if len(m) and batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), float)
                for k in range(0, len(x), 1024):
                    s = x[k : k + 1024] @ m.T
                    tested[k : k + 1024] = s.max(1)
                    if bad.any():
                        failed[k : k + 1024] = s[:, bad].max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(failed, from_pandas=True), pa.array(tested, from_pandas=True)], ["task_id", "failed", "tested"])

    return candidates.mapInArrow(each, "task_id long, failed double, tested double")


def top_tasks(scores: DataFrame, k: int) -> DataFrame:
    """The k tasks of the greatest utility, to nine decimals, the smaller id first on ties."""
    return scores.orderBy(F.round("utility", 9).desc(), F.asc("task_id")).limit(k)


def summary(results: DataFrame) -> DataFrame:
    """total, errors and error_rate of (task_id, is_correct); the rate of no result is 0."""
    made = results.agg(F.count("*").alias("total"), F.count_if(~F.col("is_correct")).alias("errors"))
    return made.withColumn("error_rate", F.round(F.when(F.col("total") > 0, F.col("errors") / F.col("total")).otherwise(0.0), 6))


def error_indices(results: DataFrame) -> DataFrame:
    """(task_id) of the failed tasks, in order: rows, as they may be many."""
    return results.filter(~F.col("is_correct")).select("task_id").orderBy("task_id")


def hard_tasks(results: DataFrame) -> DataFrame:
    """The failed tasks with new numbers from 0 in the order of task_id."""
    return numbered(results.filter(~F.col("is_correct")), "task_id", "question_id")


def shuffled_trials(tasks: DataFrame, trials: int, seed: int) -> DataFrame:
    """``tasks`` (task_id, options, ...) once for each ``trial`` from 0, the options in an order of its own."""
    rows = tasks.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    keyed = F.transform("options", lambda x, i: F.struct(order_key(seed, F.col("task_id"), F.col("trial"), x, i).alias("h"), x.alias("x")))
    return rows.withColumn("options", F.transform(F.array_sort(keyed), lambda s: s["x"]))


def mean_accuracy(results: DataFrame, key: str) -> DataFrame:
    """Mean accuracy of each task over its trials."""
    return results.groupBy(key).agg(F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"), F.count("*").alias("trials"))


def dynamic_evaluation(spark: SparkSession, pool: DataFrame, model: Callable[[DataFrame], DataFrame], budget: int, batch: int, weight: float = 0.2, save: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Evaluate ``budget`` tasks of ``pool`` (task_id, embedding) in batches: the first by id, each other by utility.

    ``model`` adds is_correct to tasks; ``save(history, step)`` writes the history and returns it as read back, which
    cuts the lineage. Batches are clamped to the budget, tasks already tested aren't tested again, and a pool that
    runs out ends the loop. The result has (task_id, embedding, is_correct, step).
    """
    keep = save or (lambda df, step: df.cache())
    done = keep(model(pool.orderBy("task_id").limit(min(batch, budget))).withColumn("step", F.lit(0)), 0)
    n, step = done.count(), 0
    while n < budget:
        rest = pool.join(done.select("task_id"), "task_id", "left_anti")
        chosen = top_tasks(utility(rest, done, weight), min(batch, budget - n))
        step += 1
        fresh = model(pool.join(chosen.select("task_id"), "task_id", "left_semi")).withColumn("step", F.lit(step))
        done = keep(done.unionByName(fresh), step)
        m = done.count()
        if m == n:
            break
        n = m
    return done
