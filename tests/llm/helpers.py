"""Small document tables with every awkward case."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the er on ti ing re en an th st or ed nd ea ou es ha at".split()


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    lines = [" ".join(words[i : i + 40]) for i in range(0, n, 40)]
    return "\n".join(lines)


def awkward(seed: int = 5) -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, copies, near copies, and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 200)) for _ in range(12)]
    texts = [None, "", "   \n\t ", "a", "É ü", "x" * 50_000, prose(rng, 20_000)]
    texts += base
    texts += [base[0], base[0] + " ", base[1].replace(" ", "  "), base[2].upper()]
    near = base[3].split(" ")
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), base[4] + "\nan added line at the end of it"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", "é", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base[5], None, None, None), (None, None, None, None, None)]
    return rows


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def clashing(df, *names):
    """The table with extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("extra"))
    return df


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=repr)
