"""Mixing sources to target weights along a time-varying curriculum.

A plan wants a mixture of so many tokens with a share for each source. A source's weight changes over the mixture by a
piecewise linear schedule, stated by the plan or made from what is scarce, whose integral is its share. Records stand in a fixed random order within their source; a record's cumulative
token demand, put through the inverse of the integrated schedule, is its training position in [0, 1), and a range sort by
position is the mixture. Small sources are gone through again, each record at most ``max_repeats`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm.encoding import count_column
from weftline.operators.prefix import running_sum
from weftline.runtime import materialize

#: Steepness of the default schedules: a source's weight at the ends of the mixture differs from its share by at most this factor.
RAMP = 0.5


def source_key(name: str) -> Column:
    """Source names without regard to case, outer blanks, and hyphen, blank or underscore between words; empty is null."""
    key = F.regexp_replace(F.trim(F.lower(F.col(name))), r"[\s_-]+", "_")
    return F.when(key != "", key)


KNOTS = "array<struct<at:double,weight:double>>"


def schedules(targets: DataFrame, curriculum: DataFrame | None = None, ramp: float = RAMP) -> DataFrame:
    """Give each source of a plan its schedule as ``knots``: places in [0, 1] with weights, linear in between, whose integral is 1.

    ``curriculum`` (``plan_id, source_name, at, weight``) states schedules by any number of knots; a weight is relative to the
    source's others, as its share is the plan's. Before the first and after the last knot the weight stays. Null or negative
    weights count 0; a source whose weights are all 0 keeps its share evenly. Sources without one have a linear schedule, from
    plenty to scarcity: the more of its records a share takes, the later it comes, by at most ``ramp`` at the ends.
    """
    plan = Window.partitionBy("plan_id")
    place = F.percent_rank().over(plan.orderBy(F.coalesce(F.col("target_share") / F.col("held"), F.lit(float("inf"))), "source")) * 2 - 1
    mean = F.sum(F.col("place") * F.col("target_share")).over(plan) / F.sum("target_share").over(plan)
    slope = (F.col("place") - F.col("mean")) * (ramp / 2)
    knot = lambda at, weight: F.struct(at.cast("double").alias("at"), weight.cast("double").alias("weight"))
    rows = targets.withColumn("place", place).withColumn("mean", F.coalesce(mean, F.lit(0.0)))
    rows = rows.withColumn("knots", F.array(knot(F.lit(0.0), 1 - slope), knot(F.lit(1.0), 1 + slope))).drop("place", "mean")
    if curriculum is None:
        return rows
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("at")))
    # A plan states a few knots for each of its few sources.
    stated = curriculum.filter(F.col("at").isNotNull()).groupBy("plan_id", source_key("source_name").alias("source")).agg(F.array_sort(F.collect_list(knot(at, weight))).alias("k"))
    first, last = F.get("k", F.lit(0)), F.element_at("k", -1)
    whole = F.concat(F.array(knot(F.lit(0.0), first["weight"])), F.col("k"), F.array(knot(F.lit(1.0), last["weight"])))
    stated = stated.withColumn("k", whole).withColumn("area", area("k"))
    stated = stated.filter("area > 0").select("plan_id", "source", F.transform("k", lambda x: knot(x["at"], x["weight"] / F.col("area"))).alias("k"))
    return rows.join(stated, ["plan_id", "source"], "left").withColumn("knots", F.coalesce("k", "knots")).drop("k")


def pieces(knots: str) -> Column:
    """The pieces between neighbouring knots: where each begins, how long it is, and the weights at its ends."""
    k = F.col(knots)
    return F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), lambda a, b: F.struct(
        a["at"].alias("at"), (b["at"] - a["at"]).alias("long"), a["weight"].alias("low"), b["weight"].alias("high")))


def area(knots: str) -> Column:
    """The integral of a schedule over [0, 1]."""
    return F.aggregate(pieces(knots), F.lit(0.0), lambda a, p: a + p["long"] * (p["low"] + p["high"]) / 2)


def invert(u: str, knots: str) -> Column:
    """The place ``t`` in [0, 1] where the integrated schedule reaches ``u``: the piece it is reached in, and the root of its parabola there."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("t"))

    def step(acc, p):
        whole = p["long"] * (p["low"] + p["high"]) / 2
        rest = F.greatest(F.lit(0.0), F.col(u) - acc["sum"])
        bend = F.when(p["long"] > 0, (p["high"] - p["low"]) / p["long"]).otherwise(0.0)
        root = F.sqrt(F.greatest(F.lit(0.0), p["low"] * p["low"] + 2 * bend * rest))
        along = F.when(p["low"] + root > 0, 2 * rest / (p["low"] + root)).otherwise(0.0)
        here = acc["t"].isNull() & (whole > 0) & (F.col(u) <= acc["sum"] + whole + 1e-12)
        t = F.when(here, p["at"] + F.least(p["long"], along)).otherwise(acc["t"])
        return F.struct((acc["sum"] + whole).alias("sum"), t.alias("t"))

    return F.coalesce(F.aggregate(pieces(knots), start, step)["t"], F.lit(1.0))


def demands(documents: DataFrame, targets: DataFrame, ramp: float = RAMP, curriculum: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Token counts per document with their running sums per source, and per plan and source what is wanted and used.

    ``mix_targets`` is a fixed, small table; the join with source totals has one row per source.
    """
    texts = documents.select("doc_id", source_key("source").alias("source"), "text")
    counted = materialize(count_column(texts, "text", "tokens", keep=("doc_id", "source")), "counted")
    placed = materialize(
        running_sum(counted.filter(F.col("tokens") > 0), ["source"], ["doc_id"], "tokens", "before"), "placed")
    sizes = placed.groupBy("source").agg(F.sum("tokens").alias("held"))
    total = placed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()["tokens"]
    wanted = targets.groupBy("plan_id", source_key("source_name").alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_factor").alias("size_factor"))
    plan = (
        schedules(wanted.join(sizes, "source", "left"), curriculum, ramp)
        .withColumn("held", F.coalesce("held", F.lit(0)))
        .withColumn("wanted", F.col("target_share") * F.col("size_factor") * F.lit(total))
        .withColumn("allowed", F.least(F.col("wanted"), (F.col("held") * F.col("max_repeats")).cast("double")))
        .withColumn("passes", F.when(F.col("held") > 0, F.floor(F.col("allowed") / F.col("held"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("allowed") - F.col("passes") * F.col("held"))
    )
    return placed, plan


def uses(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """How often each record is used in each plan: once per full pass, and once more if its middle lies within the rest."""
    # One row per plan and source, and plans are few and fixed: the small side is broadcast by its measured size.
    return (
        placed.join(plan.filter(F.col("held") > 0), "source")
        .withColumn("n", F.col("passes") + F.when(F.col("before") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
        .filter(F.col("n") > 0)
    )


def mixture(documents: DataFrame, targets: DataFrame, ramp: float = RAMP, curriculum: DataFrame | None = None) -> DataFrame:
    """``plan_id, position, doc_id, source, repeat, tokens``, sorted by plan and position.

    Defined results: documents without tokens (null, empty) are never used; a source no plan names is left out; a source
    without records gives nothing and its share is not handed to others, so the others keep their proportions; of a source
    too small for its share every record is used ``max_repeats`` times. A source misses its tokens by half a record at most.
    ``curriculum`` gives plans schedules of their own (``schedules``).
    """
    placed, plan = demands(documents, targets, ramp, curriculum)
    each = uses(placed, plan).withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    middle = (F.col("repeat") - 1) * F.col("held") + F.col("before") + F.col("tokens") / 2
    return (
        each.withColumn("u", F.least(F.lit(1.0), middle / F.greatest(F.col("allowed"), middle)))
        .withColumn("position", invert("u", "knots"))
        .select("plan_id", "position", "doc_id", "source", F.col("repeat").cast("int").alias("repeat"), "tokens")
        .orderBy("plan_id", "position", "source", "doc_id", "repeat")
    )


def shares(documents: DataFrame, targets: DataFrame, ramp: float = RAMP) -> DataFrame:
    """Per plan and source the target and the actual share, tokens wanted and used, records used, and the most repeats."""
    placed, plan = demands(documents, targets, ramp)
    used = uses(placed, plan).groupBy("plan_id", "source").agg(
        F.sum(F.col("n") * F.col("tokens")).alias("used"), F.sum("n").alias("records"), F.max("n").alias("repeats"))
    over = Window.partitionBy("plan_id")
    return (
        plan.join(used, ["plan_id", "source"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
        .select(
            "plan_id", "source", "target_share",
            F.round(F.col("used") / F.sum("used").over(over), 6).alias("actual_share"),
            F.round("wanted", 3).alias("wanted_tokens"), F.col("used").alias("used_tokens"), F.col("held").alias("held_tokens"),
            F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats")
    )
