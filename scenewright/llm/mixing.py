"""Mixing sources to target weights by systematic sampling.

Within a source every document's expected copies are the source's target over its size. The expected copies are
prefix-summed in order of size, one offset drawn for the source is added, and a document is taken once for each integer
boundary that its stretch crosses. In order of size the words taken differ from the target by a document's size or so.

The prefix sum is distributed: rows are range-partitioned by (source, size, id), so a hot source spreads over many
tasks, and each range's rank starts where the ranges before it end. Only (id, source, size) are shuffled, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, fresh, partitions, pick

WORD = r"[^\x20\x09-\x0D]+"
#: A source gives at most so many times its size.
MOST = 3
SEED = "mix-1"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate): one row for each source of ``sizes`` (source, size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating; targets sum to all sizes, none above ``MOST``
    times its source's. Water-filling: by ascending cap over weight, sources are capped until the rest's equal share a
    weight fits. A table of one row a source is ordered here, and nothing larger.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = F.lit(0)  # a single group: the order of the sources is global
    weighed = by.withColumn("w", (F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.partitionBy(one).orderBy((MOST * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    summed = weighed.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy(one)) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))).alias("left"),
        F.sum("w").over(on).alias("w_on"),
        F.row_number().over(order).alias("r"),
    )
    fits = whole("left") * whole("w") <= MOST * whole("source_size") * whole("w_on")
    start = F.min(F.when(fits, F.struct("r", "left", "w_on"))).over(Window.partitionBy(one))
    found = summed.withColumn("s", start)
    target = F.when(F.col("r") < F.col("s.r"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("s.left").cast("double") * F.col("w") / F.col("s.w_on"))
    return found.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def offset(source: Column) -> Column:
    """The source's random offset in [0, 1): a hash, so that reruns agree."""
    text = F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _copies(spark: SparkSession, docs: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, doc_id, size, source_size, target, copies, taken) for each row of ``docs`` (``keys``, doc_id, source, text)."""
    cut = Cut(spark)
    t = docs.select(*keys, "doc_id", "source", F.xxhash64("text").alias("tie"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = cut(t, "sizes")
    parts = partitions(sizes)
    order = [F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    ranged = cut(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last(), *order).withColumn("pid", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("pid", "source").orderBy(*order)))
    counts = ranged.groupBy("pid", "source").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("pid").alias("p"), F.col("source").alias("o"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    goals = targets(sizes).withColumnRenamed("source", "g")
    rows = local.join(starts, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("o"))).join(goals, F.col("source").eqNullSafe(F.col("g")))
    rank = F.col("ahead") + F.col("rank")
    copies = F.floor(offset(F.col("source")) + rank * F.col("rate")) - F.floor(offset(F.col("source")) + (rank - 1) * F.col("rate"))
    return rows.select(*keys, "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of ``docs`` (doc_id, source, text).

    size: words of the text, 0 if it is null or blank; such rows take no words whatever their copies. Rows that repeat
    (source, size, doc_id) come in the order of their text hashes. A null source is a source of its own, a null doc_id the last of its size. An
    empty table gives an empty result.
    """
    return _copies(spark, pick(docs, doc_id="doc_id", source="source", text="text"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns and ``copy``, from 1. Rows that aren't taken are left out.

    The rows are written with numbers first, so that copies, which are decided on sizes only, come back to the rows they are for.
    """
    row, copy, times = fresh(docs, "mix_row", "copy", "mix_copies")
    kept = Cut(spark)(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    own = pick(kept, mix_key=row, doc_id="doc_id", source="source", text="text")
    taken = _copies(spark, own, "mix_key").filter("copies > 0").select(F.col("mix_key").alias("taken_key"), F.col("copies").cast("int").alias(times))
    joined = kept.join(taken, F.col(row) == F.col("taken_key"))
    return joined.select(*[kept[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))


MIX_SQL = r"""
    WITH d AS (
        SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
    ), b AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
    ), w AS (
        SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM b
    ), o AS (
        SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
               sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_on,
               row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS r
        FROM w
    ), s AS (
        SELECT min(r) AS r0, arg_min(rest, r) AS rest0, arg_min(w_on, r) AS w0 FROM o WHERE rest * w <= 3 * source_size * w_on
    ), t AS (
        SELECT source, source_size, CASE WHEN r < r0 THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest0 AS DOUBLE) * w / CAST(w0 AS DOUBLE) END AS target,
               CAST(('0x' || substr(md5('mix-1' || coalesce(':' || source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
        FROM o, s
    ), k AS (
        SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS n FROM d
    ), c AS (
        SELECT k.doc_id, k.size, t.source_size, t.target,
               CAST(floor(u + n * (CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END))
                    - floor(u + (n - 1) * (CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END)) AS BIGINT) AS copies
        FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
