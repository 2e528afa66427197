"""Schedules of a mixture against numerical integration, and products whatever the order of their words."""

import random

from pyspark.sql import functions as F

from weftline.llm import mixing, same_product

ITEMS = "parent_asin string, title string, features array<string>, description array<string>, details map<string,string>, store string"


def test_curriculum_is_integrated_and_inverted(spark):
    knots = {"a": [(0.0, 2.0), (0.5, 0.0), (1.0, 4.0)], "b": [(0.3, 1.0)], "c": [(0.2, 0.0), (0.2, 3.0), (0.6, 1.0)]}
    targets = spark.createDataFrame([(1, s, 0.25, 1, 1.0, 10.0 * i) for i, s in enumerate("abcd", 1)], "plan_id int, source string, target_share double, max_repeats int, size_factor double, held double")
    curriculum = spark.createDataFrame([(1, f" {s.upper()}", at, w) for s, k in knots.items() for at, w in k] + [(1, "d", 0.5, -1.0), (1, "d", None, 2.0)], "plan_id int, source_name string, at double, weight double")
    rows = mixing.schedules(targets, curriculum).withColumn("u", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / 20.0))).withColumn("t", mixing.invert("u", "knots")).collect()
    assert len(rows) == 84
    for r in rows:
        k = [(x.at, x.weight) for x in r.knots]
        reached = 0.0
        for (a, v), (b, w) in zip(k, k[1:]):
            end = min(b, r.t)
            if end > a:
                at_end = v + (w - v) * (end - a) / (b - a)
                reached += (end - a) * (v + at_end) / 2
        assert abs(reached - r.u) < 1e-6
    weights = {r.source: [(x.at, round(x.weight, 6)) for x in r.knots] for r in rows}
    assert weights["b"] == [(0.0, 1.0), (0.3, 1.0), (1.0, 1.0)] and len(weights["d"]) == 2  # d states nothing usable


def test_default_schedules_end_with_what_is_scarce(spark):
    targets = spark.createDataFrame([(1, "much", 0.5, 1, 1.0, 1000.0), (1, "little", 0.3, 4, 1.0, 10.0), (1, "none", 0.2, 4, 1.0, None)], "plan_id int, source string, target_share double, max_repeats int, size_factor double, held double")
    slopes = {r.source: r.knots[1].weight - r.knots[0].weight for r in mixing.schedules(targets).collect()}
    assert slopes["much"] < slopes["little"] < slopes["none"]
    for at in (0, 1):
        assert abs(sum(r.target_share * r.knots[at].weight for r in mixing.schedules(targets).collect()) - 1) < 1e-9


def test_word_order_and_k(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("tar", "vim", "zel", "kor", "bam", "dun", "fep", "gos") for b in ("lo", "ek", "ax", "um", "in")]
    models = [rng.sample(words, 2) for _ in range(12)]
    rows = []
    for i, m in enumerate(models):
        for k in range(4):
            rows.append((f"P{i:02}{k}", " ".join([f"Brand{i % 3}x", *(m if k % 2 else m[::-1]), "shirt", "red"]), [f"by Brand{i % 3}x"], None, None, "s"))
    items = spark.createDataFrame(rows, ITEMS)
    got = {r.parent_asin: r["product"] for r in same_product.cluster(items, 0.3).collect()}
    for i in range(len(models)):
        assert len({got[f"P{i:02}{k}"] for k in range(4)}) == 1
    sets = spark.createDataFrame([("A", [("x", 1), ("y", 2), ("z", 4)]), ("B", [("y", 2)])], "asin string, tokens array<struct<w:string,n:bigint>>")
    three = {(r.asin, r.combination, r.gap, r.place): r.usual for r in same_product.combinations(sets, 3).collect()}
    assert set(three) == {("A", "x y z", 2, 0), ("B", "y", 0, 0)} and abs(three["A", "x y z", 2, 0] - 2.0) < 1e-9
    assert {r.combination for r in same_product.combinations(sets, 2).collect()} == {"x y", "x z", "y z", "y"}
