"""Text encoders, choice search, cached inference and baseline models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relations import option_labels
from ..rng import order_key

Encoder = Callable[[list[str]], np.ndarray]
DIM = 64


def hashed_ngrams(texts: list[str], dim: int = DIM) -> np.ndarray:
    """The offline encoder: counts of groups of three characters in hashed places, with unit length; an empty text is zero but for its blanks.

    A group of code points a, b, c has the number (7919 a + 104729 b + 1299709 c) mod 2^31, whose lowest bit is the sign; all texts are counted at once.
    """
    padded = [f"  {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in padded], np.int64)
    if not len(texts):
        return np.zeros((0, dim))
    own, at = np.repeat(np.arange(len(texts)), size - 2), np.arange((size - 2).sum()) + np.repeat(2 * np.arange(len(texts)), size - 2)
    h = (7919 * code[at] + 104729 * code[at + 1] + 1299709 * code[at + 2]) % (1 << 31)
    made = np.bincount(own * dim + (h // 2) % dim, weights=2.0 * (h % 2) - 1, minlength=len(texts) * dim).reshape(-1, dim)
    length = np.linalg.norm(made, axis=1, keepdims=True)
    return made / np.maximum(length, 1e-12)


def embed_tasks(tasks: DataFrame, encoder: Encoder = hashed_ngrams) -> DataFrame:
    """(task_id, embedding) of ``tasks`` (task_id, layout_text, question, answer): the three texts' unit vectors in a row, scaled to length 1.

    A null text counts as empty. The encoder is called in the tasks, once for each batch and column.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.hstack([encoder([x or "" for x in b[c]]) for c in ("layout_text", "question", "answer")])
            v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
            yield pd.DataFrame({"task_id": b["task_id"], "embedding": list(v)})

    rows = tasks.select(F.col("task_id").cast("long").alias("task_id"), "layout_text", "question", "answer")
    return rows.mapInPandas(each, "task_id long, embedding array<double>")


def search_choice(rows: DataFrame, encoder: Encoder = hashed_ngrams) -> DataFrame:
    """(id, resolved) of ``rows`` (id, answer, choices): the choice whose encoding is most like the answer's, the first on ties; null without choices."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [0 if c is None else len(c) for c in b["choices"]]
            flat = [x or "" for c in b["choices"] if c is not None for x in c]
            a, v = encoder([x or "" for x in b["answer"]]), encoder(flat) if flat else np.zeros((0, 1))
            ends = np.cumsum(sizes)
            found = [flat[e - n + int(np.argmax(v[e - n : e] @ q))] if n else None for q, e, n in zip(a, ends, sizes)]
            yield pd.DataFrame({"id": b["id"], "resolved": found})

    return rows.select(F.col("id").cast("long").alias("id"), "answer", "choices").mapInPandas(each, "id long, resolved string")


def prompt(question: Column, choices: Column) -> Column:
    """The question, its options and what to answer, a line each."""
    lines = F.concat(F.array(question, F.lit("")), option_labels(choices), F.array(F.lit("Give the letter of the right option.")))
    return F.array_join(lines, "\n")


def cache_key(model: str, data: Column, text: Column) -> Column:
    """A key that is the same in every process: SHA-256 over model, data and prompt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.coalesce(data, F.lit("unknown")), text), 256)


def infer(prompts: DataFrame, cache: DataFrame, model: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers (key, response) to ``prompts`` (key, prompt), and the cache (key, response) with what was new.

    Only prompts without a cached response go to the model, each once; a null response isn't a hit and isn't kept.
    """
    known = cache.filter("response is not null").select("key", "response")
    missing = prompts.dropDuplicates(["key"]).join(known, "key", "left_anti")
    new = model(missing).select("key", "response").filter("response is not null")
    after = known.unionByName(new)
    return prompts.select("key").join(after, "key", "left"), after


def first_option(prompts: DataFrame) -> DataFrame:
    """The baseline that always answers A."""
    return prompts.withColumn("response", F.lit("A"))


def longest_option(prompts: DataFrame) -> DataFrame:
    """The baseline that answers with the longest option, the first on ties."""
    lines = F.filter(F.split("prompt", "\n"), lambda x: x.rlike(r"^\([A-Z]\) "))
    best = F.array_min(F.transform(lines, lambda x, i: F.struct((-F.char_length(x)).alias("n"), i.alias("i"), x.alias("x"))))["x"]
    return prompts.withColumn("response", best)


MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {"first-option": first_option, "longest-option": longest_option}


def model(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name]


def sample_names(lists: DataFrame, names: list[str], seed: int, count: int | None = None, least: int = 2, most: int = 9) -> DataFrame:
    """(id, names): for each row of ``lists`` (id) so many different names, between ``least`` and ``most`` by a hash if ``count`` is None."""
    top = min(most, len(names))
    pick = F.least(F.greatest(F.lit(count if count is not None else 0), F.lit(least)), F.lit(top))
    if count is None:
        pick = (F.lit(least) + F.pmod(F.conv(F.substring(order_key(seed, "n", F.col("id")), 1, 8), 16, 10).cast("long"), F.lit(top - least + 1))).cast("int")
    keyed = F.transform(F.array(*map(F.lit, names)), lambda x: F.struct(order_key(seed, F.col("id"), x).alias("h"), x.alias("x")))
    return lists.select("id", F.transform(F.slice(F.array_sort(keyed), F.lit(1), pick), lambda s: s["x"]).alias("names"))
