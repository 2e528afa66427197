"""Running sums and ranks within groups of any size, without gathering a group in one task.

Rows of a group are spread over buckets that keep the wanted order (equal parts of a hash range, or slices between cut
points of a score). Bucket totals are few, so their running sums are cheap; a row's position is its bucket's offset plus
its position inside the bucket. The window of the last step is partitioned by group *and* bucket: a group that holds a third
of all rows is worked on by as many tasks as it has buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.runtime import materialize

#: Rows that one task should sort; buckets and slices are as many as the largest group or table needs for that.
ROWS = 500_000


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows of the group that come before a row, in the order of
    ``xxhash64(order)`` and then ``order``: a fixed shuffle of each group. ``order`` must tell rows of a group apart.

    ``buckets`` per group follow from the largest group's measured size. Defined results: a null ``value`` counts 0; null
    group keys form a group; an empty table gives an empty one; the sums don't depend on the buckets.
    """
    if buckets is None:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        buckets = 2 ** max(1, math.ceil(math.log2(max(1, largest / ROWS))))
    hashed = df.withColumn("__hash", F.xxhash64(*order)).withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - _bits(buckets)))
    counted = hashed.withColumn("__value", F.coalesce(F.col(value), F.lit(0)))
    totals = counted.groupBy(*group, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__bucket").alias("__b"),
                            F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*group, "__bucket").orderBy("__hash", *order).rowsBetween(Window.unboundedPreceding, -1)
    local = counted.withColumn("__local", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    joined = local.join(offsets, [*same, F.col("__bucket") == F.col("__b")])
    return joined.select(*df.columns, (F.col("__offset") + F.col("__local")).alias(out))


def _bits(buckets: int) -> int:
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two, 2 at least")
    return buckets.bit_length() - 1


#: Most cut points of a key: they are literals of the plan.
MOST_SLICES = 4096


def slices_for(rows: int) -> int:
    """Slices that leave ``ROWS`` rows for each, at most ``MOST_SLICES``; beyond that a slice's sort spills."""
    return min(MOST_SLICES, math.ceil(rows / ROWS))


def cut_points(df: DataFrame, key: str, value: str, slices: int) -> dict:
    """About ``slices`` cut points of ``value`` for each ``key``; their number is bounded by the few keys there are (score names)."""
    rows = df.groupBy(key).agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], 10 * slices).alias("cuts")).collect()
    return {r[key]: sorted(set(r["cuts"])) for r in rows if r["cuts"]}


def slice_of(key: str, value: str, cuts: dict) -> Column:
    """Number of the key's cut points that lie below ``value``; 0 for a key without any."""
    out = F.lit(0)
    for name, points in cuts.items():
        if not points:
            continue
        below = F.size(F.filter(F.array(*[F.lit(float(p)) for p in points]), lambda p: p < F.col(value)))
        out = F.when(F.col(key) == name, below).otherwise(out)
    return out


def mid_ranks(df: DataFrame, group: str, key: str, value: str, slices: int | None = None) -> DataFrame:
    """``group, key, value, ties, below, total`` per distinct value: rows of the group and key with a smaller value, and all of them.

    Works on counts per distinct value, so that ties, however many, are one row; slices between cut points taken over the
    whole table keep any one group from a single task. Exact for whatever cut points.
    """
    counts = (
        df.withColumn("slice", slice_of(key, value, cut_points(df, key, value, slices)))
        .groupBy(group, key, "slice", value).agg(F.count("*").alias("ties"))
    )
    counts = materialize(counts, "ties")
    totals = counts.groupBy(group, key, "slice").agg(F.sum("ties").alias("rows"))
    over = Window.partitionBy(group, key)
    offsets = totals.select(
        group, key, "slice",
        F.coalesce(F.sum("rows").over(over.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("rows").over(over).alias("total"))
    inside = Window.partitionBy(group, key, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("local", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
        .join(offsets, [group, key, "slice"])
        .select(group, key, value, "ties", (F.col("offset") + F.col("local")).alias("below"), "total")
    )


def slice_large(df: DataFrame, group: str, key: str, value: str, size: str, rows: int = ROWS) -> DataFrame:
    """Add ``slice``: which part of its ``(group, key)`` a row's ``value`` lies in, in rising order; 0 in groups of ``rows`` rows at most.

    ``size`` is the column of the group's measured size. Larger groups are cut at points taken over all of them, as many
    as the largest needs.
    """
    large = df.filter(F.col(size) > rows)
    most = large.agg(F.max(size)).first()[0] or 0
    cuts = cut_points(large, key, value, min(MOST_SLICES, math.ceil(most / rows))) if most else {}
    return df.withColumn("slice", F.when(F.col(size) > rows, slice_of(key, value, cuts)).otherwise(F.lit(0)))


def slice_offsets(sliced: DataFrame, group: str, key: str, size: str, rows: int = ROWS) -> DataFrame:
    """``group, key, slice, offset, total`` of the groups that ``slice_large`` cuts: rows in earlier slices, and in all. One row per slice."""
    counts = sliced.filter(F.col(size) > rows).groupBy(group, key, "slice").agg(F.count("*").alias("rows"))
    over = Window.partitionBy(group, key)
    return counts.select(
        group, key, "slice", F.coalesce(F.sum("rows").over(over.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("rows").over(over).alias("total"))


def number_rows(df: DataFrame, group: str, value: str, ties: list[Column | str], out: str, rows: int = ROWS, size: str | None = None) -> DataFrame:
    """Number the rows of each ``group`` from 1 by falling ``value`` and then ``ties``, whatever a group's size.

    ``size`` is a column with the size of the row's group; without it the sizes are counted, and ``df`` is read once more.
    Defined results: a null ``value`` comes last; a null group is a group; an empty table gives an empty one.
    """
    sized = df.withColumn("__n", F.col(size)) if size else None
    if sized is None:
        sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
        sized = df.join(sizes.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    keyed = sized.withColumn("__key", F.lit(0)).withColumn("__falling", F.coalesce(-F.col(value).cast("double"), F.lit(float("inf"))))
    sliced = slice_large(keyed, group, "__key", "__falling", "__n", rows)
    offsets = slice_offsets(sliced, group, "__key", "__n", rows).select(F.col(group).alias("__g"), F.col("slice").alias("__s"), "offset")
    inside = Window.partitionBy(group, "slice").orderBy("__falling", *ties)
    numbered = sliced.select(*df.columns, "slice", F.row_number().over(inside).alias("__local"))
    placed = numbered.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("slice") == F.col("__s")), "left")
    return placed.select(*df.columns, (F.col("__local") + F.coalesce("offset", F.lit(0))).cast("int").alias(out))


def below_each(counts: DataFrame, value: str, n: str, out: str, per_unit: int = 8) -> DataFrame:
    """Add ``out``, the sum of ``n`` over the rows with a smaller ``value``, to one row for each value.

    Values are cut into equal steps, ``per_unit`` to each unit: of values on a log scale there are a few hundred steps, whose
    sums are run through in one window; the rest is a window within each step.
    """
    stepped = counts.withColumn("__step", F.floor(F.col(value) * per_unit))
    steps = stepped.groupBy("__step").agg(F.sum(n).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("__step").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = stepped.withColumn("__inside", inside).join(steps.select("__step", before.alias("__before")), "__step")
    return joined.select(*counts.columns, (F.col("__inside") + F.col("__before")).alias(out))
