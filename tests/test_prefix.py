import random

from weftline.operators.prefix import mid_ranks, running_sum


def test_running_sum_is_a_prefix_sum(spark):
    random.seed(1)
    rows = [("a" if i % 3 else None, i, random.randint(0, 9) if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = running_sum(df, ["g"], ["id"], "v", "before", buckets=8).collect()
    assert len(got) == 500
    for g in ("a", None):
        part = sorted((r for r in got if r.g == g), key=lambda r: (r.before, (r.v or 0) > 0))
        total = sum(r.v or 0 for r in part)
        assert min(r.before for r in part) == 0 and max(r.before + (r.v or 0) for r in part) == total
        ends = sorted((r.before, r.before + r.v) for r in part if r.v)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert running_sum(df.limit(0), ["g"], ["id"], "v", "before", 8).count() == 0


def test_mid_ranks_exact_for_any_slices(spark):
    random.seed(2)
    rows = [(random.randint(0, 2), "k", float(random.randint(-5, 5))) for _ in range(300)] + [(9, "k", 1.0)] * 200
    df = spark.createDataFrame(rows, "g int, key string, v double")
    for slices in (2, 5, 64):
        for r in mid_ranks(df, "g", "key", "v", slices).collect():
            mine = [v for g, _, v in rows if g == r.g]
            assert (r.ties, r.below, r.total) == (mine.count(r.v), sum(v < r.v for v in mine), len(mine))
