"""The candidate pool of an evaluation, and the evaluation from generation to results.

Every step's results are written below the output folder and read again: the plan of a step doesn't grow with the budget, and a
lost executor costs nothing that was written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relations
from ..operators import evaluation, geometry, models
from ..rng import order_key
from ..schema import KINDS, TaskPlan
from ..sources import sinks
from .generate import Inputs, all_plans, first_attempts, layouts_for, scene_metadata, task_scenes, tasks


@dataclass(frozen=True)
class EvalConfig:
    budget: int = 100
    batch_size: int = 10
    pool_size: int = 1000
    weight: float = 0.2
    seed: int = 42

    def __post_init__(self):
        if min(self.budget, self.batch_size, self.pool_size) < 1:
            raise ValueError("budget, batch and pool sizes are at least 1")


POOL = "task_id long, generator_type string, category string, question string, options array<string>, answer string, layout_text string, scene_objects array<struct<name:string,object_id:string,placeholder:string>>, plan_seed long, scene_id long, distance_type string"


def candidate_pool(inputs: Inputs, size: int, seed: int, kinds: list[str] | None = None) -> DataFrame:
    """At most ``size`` tasks of all question types, shuffled: the same quota of each type, at least one.

    A type's configuration and its own seed come from a hash of the pool's seed; a type that the inputs can't make is left out. Columns are
    those of ``POOL``; task_id numbers the pool in its shuffled order.
    """
    kinds = list(KINDS) if kinds is None else kinds
    quota = max(1, size // len(kinds))
    parts, chosen = [], []
    for kind in kinds:
        plans = [p for p in all_plans(4, seed) if p.generator_type == kind]
        own = inputs.spark.range(1).select(F.conv(F.substring(order_key(seed, "pool", kind), 1, 7), 16, 10).cast("long")).first()[0]
        chosen.append(TaskPlan(kind, 4, int(own) % 1_000_000, plans[int(own) % len(plans)].generator_config))
    inputs.draw([(layouts_for(inputs, p.generator_type), p.seed, first_attempts(quota)) for p in chosen])
    for plan in chosen:
        kind = plan.generator_type
        try:
            made = tasks(inputs, plan, quota)
        except (ValueError, IndexError):
            continue
        scenes = scene_metadata(task_scenes(inputs, plan, made)).select(F.col("scene_id").alias("s_id"), "layout_description", "objects")
        text = F.col("layout_description")
        distance = F.lit(plan.generator_config.get("distance_type")).cast("string")
        rows = made.join(scenes, F.col("question_id") == F.col("s_id")).select(
            F.lit(kind).alias("generator_type"), relations.plain_category(F.lit(kind), distance).alias("category"), "question", "options", "answer",
            text.alias("layout_text"), F.transform("objects", lambda o: F.struct(o["name"].alias("name"), o["object_id"].cast("string").alias("object_id"), o["placeholder"].alias("placeholder"))).alias("scene_objects"),
            F.lit(plan.seed).cast("long").alias("plan_seed"), "scene_id", distance.alias("distance_type"),
        )
        parts.append(rows)
    if not parts:
        return inputs.spark.createDataFrame([], POOL)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    # what is numbered is the pool, as large as was asked for
    key = order_key(seed, "shuffle", F.col("generator_type"), F.col("scene_id"), F.col("question"))
    from pyspark.sql import Window

    number = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key, "question", "scene_id")) - 1).cast("long")
    return every.withColumn("task_id", number).filter(F.col("task_id") < size).select(*[c.split()[0] for c in POOL.split(", ")])


def checked(pool: DataFrame) -> DataFrame:
    """The pool; a task without a layout's description or objects stops the query when it is reached."""
    said = F.coalesce("layout_text", F.lit("")) != ""
    return pool.withColumn("layout_text", F.when(said & F.col("scene_objects").isNotNull(), F.col("layout_text")).otherwise(F.raise_error(F.lit("a task has no description of its layout")).cast("string")))


def answer(rows: DataFrame, model: Callable[[DataFrame], DataFrame], encoder: models.Encoder | None = None) -> DataFrame:
    """``rows`` (key, question, options, answer, ...) with ``model_answer`` and ``is_correct``: the model sees a prompt, its response is resolved.

    An answer that can't be resolved by rules is searched among the options by ``encoder``, if there is one.
    """
    asked = rows.withColumn("prompt", models.prompt(F.col("question"), F.col("options")))
    said = model(asked).withColumn("resolved_", evaluation.resolve_answer(F.coalesce("response", F.lit("")), F.col("options")))
    if encoder is not None:
        near = models.search_choice(said.select(F.col("task_id").alias("id"), F.coalesce("response", F.lit("")).alias("answer"), F.col("options").alias("choices")), encoder)
        near = near.select(F.col("id").alias("n_id"), F.col("resolved").alias("near_"))
        said = said.join(near, F.col("task_id") == F.col("n_id"), "left").withColumn("resolved_", F.when(F.col("resolved_") == "", F.col("near_")).otherwise(F.col("resolved_"))).drop("n_id", "near_")
    return said.withColumn("model_answer", F.col("resolved_")).withColumn("is_correct", F.col("model_answer") == F.col("answer")).drop("prompt", "response", "resolved_")


def evaluate(inputs: Inputs, model: Callable[[DataFrame], DataFrame], config: EvalConfig, folder: str, clouds: DataFrame | None = None, encoder: models.Encoder = models.hashed_ngrams, kinds: list[str] | None = None) -> DataFrame:
    """Spend the budget: a first pool is evaluated as it is, then each step the tasks of the greatest utility of a new pool.

    Writes ``results.json`` (config, stats with the failed indices, results) and, if tasks failed, ``hard_data`` with its clouds below
    ``folder``. The result has (task_id, step, utility, question, options, answer, model_answer, is_correct, category, layout_text, embedding, ...),
    numbered in the order of evaluation. A pool that is empty ends the evaluation.
    """
    spark, at = inputs.spark, f"{folder}/history"
    done, n, step = None, 0, 0
    while n < config.budget:
        k = min(config.batch_size, config.budget - n)
        pool = candidate_pool(inputs, config.batch_size if step == 0 else config.pool_size, config.seed + step, kinds)
        pool.write.mode("overwrite").parquet(f"{folder}/pools/step={step}")
        pool = spark.read.schema(pool.schema).parquet(f"{folder}/pools/step={step}")
        tasks_ = checked(pool).withColumn("pool_id", F.col("task_id")).drop("task_id")
        texts = tasks_.select(F.col("pool_id").alias("task_id"), "layout_text", "question", "answer")
        embedded = models.embed_tasks(texts, encoder).withColumnRenamed("task_id", "e_id")
        rows = tasks_.join(embedded, F.col("pool_id") == F.col("e_id")).drop("e_id")
        if step == 0:
            chosen = rows.orderBy("pool_id").limit(k).withColumn("utility", F.lit(None).cast("double"))
            order = F.col("pool_id")
        else:
            scores = evaluation.utility(rows.select(F.col("pool_id").alias("task_id"), "embedding"), done, config.weight)
            top = evaluation.top_tasks(scores, k).withColumnRenamed("task_id", "t_id")
            chosen = rows.join(F.broadcast(top), F.col("pool_id") == F.col("t_id")).drop("t_id")
            order = -F.round("utility", 9)
        from pyspark.sql import Window

        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "pool_id")) - 1 + n  # a batch of the budget
        found = answer(chosen.withColumn("task_id", number.cast("long")), model).withColumn("step", F.lit(step)).drop("pool_id")
        found.write.mode("overwrite").parquet(f"{at}/step={step}")
        done = spark.read.schema(found.schema).parquet(*[f"{at}/step={s}" for s in range(step + 1)])
        before, n, step = n, done.count(), step + 1
        if n == before:
            break
    if done is None:
        raise ValueError("the budget is spent before it began")
    save(done, config, folder)
    failed = done.filter(~F.col("is_correct"))
    if clouds is not None and not failed.isEmpty():
        hard = evaluation.hard_tasks(failed)
        sinks.write_scene_clouds(_clouds(inputs, hard, clouds), f"{folder}/hard_data").count()
    return done


def _clouds(inputs: Inputs, hard: DataFrame, clouds: DataFrame) -> DataFrame:
    """The points of the scenes of failed tasks, by the plans that made them: at most as many plans as tasks in the budget."""
    made = None
    for r in hard.select("generator_type", "plan_seed", "distance_type").distinct().collect():
        plan = next(p for p in all_plans(4, int(r.plan_seed)) if p.generator_type == r.generator_type)
        own = hard.filter((F.col("generator_type") == r.generator_type) & (F.col("plan_seed") == r.plan_seed)).select("scene_id", "question_id")
        rows = task_scenes(inputs, plan, own)
        points = geometry.scene_points(rows.withColumn("cloud_id", F.col("object_id")), clouds).join(own, "scene_id")
        made = points if made is None else made.unionByName(points)
    return made


def save(done: DataFrame, config: EvalConfig, folder: str) -> dict:
    """``results.json``: the configuration, stats, and the results in order, streamed; and the failed tasks as a task set."""
    stats = evaluation.summary(done).first().asDict()
    stats["error_indices"] = [r.task_id for r in evaluation.error_indices(done).toLocalIterator()]  # at most the budget
    columns = ["task_id", "question", "answer", "model_answer", "is_correct", "utility", "category", "options", F.col("layout_text").alias("layout_description")]
    sinks.write_results(done.select(*columns).orderBy("task_id"), stats, asdict(config), folder)
    hard = evaluation.hard_tasks(done)
    file = F.concat(F.lpad(F.col("question_id").cast("string"), 6, "0"), F.lit(".npy"))
    sinks.write_hard_data(hard.select("question_id", file.alias("point"), "category", "question", "options", "answer"), config.seed, folder)
    return stats
