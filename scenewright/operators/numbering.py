"""Dense numbers over keys without one task that orders all rows, and joins with tables that may be small; columns that are made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a range.
WIDTH = 4096
#: Rows of a table that is still broadcast.
FEW = 200_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows.

    A small table has few keys: joined by a shuffle, the rows of the other side would be in as few tasks. A large one has many, over which they spread.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the order of ``key``, a whole number that doesn't repeat.

    Rows are ranked within ranges of ``WIDTH`` keys, and each range starts where those before it end: only one row a range is ordered
    in one task.
    """
    ranged = df.withColumn("range_", F.floor(F.col(key) / WIDTH))
    local = ranged.withColumn("rank_", F.row_number().over(Window.partitionBy("range_").orderBy(key)))
    ahead = Window.partitionBy(F.lit(0)).orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)
    starts = local.groupBy(F.col("range_").alias("r_")).agg(F.count("*").alias("n_")).select("r_", F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("ahead_"))
    made = local.join(starts, F.col("range_") == F.col("r_")).withColumn(name, (F.col("ahead_") + F.col("rank_") - 1).cast("long"))
    return made.drop("range_", "rank_", "r_", "ahead_")


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with more columns, made once a row. They come out of a generator: the optimizer puts a projected column in the place of each of its uses, and
    a description would be parsed some fifty times."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
