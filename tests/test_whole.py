"""Queries give every row they are asked for, not only the ones that are easy to reach."""

import math
from datetime import datetime

from weftline.operators import metrics
from weftline.plans import dialogue, pool, quantities

TURNS = "request_id bigint, session_id string, turn int, user_message string, received_at timestamp"
CANDIDATES = "request_id bigint, session_id string, parent_asin string, pool_pos int, route_scores map<string,double>"
META = ("parent_asin string, colors array<string>, materials array<string>, cats array<string>, store string, sizes array<string>, price double, "
        "vocab string, popularity double")
ITEMS = "parent_asin string, store string, rating_number bigint"


def write(spark, folder, turns, candidates, meta):
    """Tables of requests (id, text), candidates (request, product, position, scores) and products (by column)."""
    names = [c.split()[0] for c in META.split(", ")]
    rows = {
        "turns": ([(r, f"s{r}", 1, text, datetime(2026, 1, 1)) for r, text in turns], TURNS),
        "candidates": ([(r, f"s{r}", a, pos, scores) for r, a, pos, scores in candidates], CANDIDATES),
        "catalog_meta": ([tuple({"parent_asin": a, **m}.get(n) for n in names) for a, m in meta.items()], META)}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_popularity_of_every_product(spark, tmp_path):
    rows = [(f"A{i:02}", "one store", 1000 - i) for i in range(15)] + [("B", "", 3), ("C", None, 0), ("D", "s", None), ("E", "s", -1)]
    spark.createDataFrame(rows, ITEMS).write.parquet(f"{tmp_path}/catalog_items.parquet")
    got = [tuple(r) for r in dialogue.popularity_feature(spark, str(tmp_path)).select("parent_asin", "popularity").collect()]
    assert sorted(got) == sorted((a, round(math.log1p(n), 9) if n is not None and n >= 0 else None) for a, _, n in rows)


def test_rerank_is_a_permutation_of_every_pool(spark, tmp_path):
    """Zero scorers, candidates without words, and requests without evidence keep the incoming order."""
    spots = [("D", 1), ("C", 2), ("B", 3), ("A", 4), ("N", 5), ("Z", None)]
    candidates = [(r, a, pos, None) for r in (1, 2, 3) for a, pos in spots] + [(1, "D", 9, None)]
    meta = {"A": {"vocab": "linen hemp"}, "B": {"vocab": "linen"}, "C": {"vocab": "wool"}, "D": {"vocab": "wool"}, "N": {}}
    folder = write(spark, tmp_path, [(1, "hemp or linen"), (2, "nothing that the pool has"), (3, None)], candidates, meta)
    got = {}
    for r in sorted(pool.pool_idf_rerank(spark, folder).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request_id, []).append((r.parent_asin, r.score))
    zeros = [(a, 0.0) for a, _ in spots]
    assert got == {1: [("A", round(math.log(3) + math.log(2), 6)), ("B", round(math.log(2), 6)), *[z for z in zeros if z[0] not in "AB"]], 2: zeros, 3: zeros}


def test_rounds_of_the_reference(spark):
    """10,000 rounds by default: a p below 0.001 can be told, and all rounds are counted."""
    d = spark.createDataFrame([(i, 1.0) for i in range(40)], "k int, d double")
    row = metrics.sign_flips(d, "k", "d").first()
    assert row.rounds == 10_000 and row.p == round(1 / 10_001, 6)
    values = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "k int, v double")
    assert metrics.bootstrap(values, "k", "v").first() == metrics.bootstrap(values, "k", "v", 10_000).first() != metrics.bootstrap(values, "k", "v", 500).first()


def test_units_of_prices(spark, tmp_path):
    """Stated prices are converted, an unstated one is predicted or kept for review, an unusable one isn't a figure."""
    items = [(f"A{i:03}", "euro" if i % 2 else "yen", ["Shoes"], None, 50.0 + i % 9 if i % 2 else 9000.0 + i % 9) for i in range(200)]
    items += [("U", "none", ["Shoes"], None, 9004.0), ("V", None, None, {"Weight": "2 kg"}, 1.0), ("W", "euro", None, None, float("nan"))]
    spark.createDataFrame(items, "parent_asin string, store string, categories array<string>, details map<string,string>, price double").write.parquet(f"{tmp_path}/catalog_items.parquet")
    spark.createDataFrame([("euro", "EUR", None), ("yen", "JPY", "prices in minor units")], "store string, currency string, feed_note string").write.parquet(f"{tmp_path}/stores.parquet")
    spark.createDataFrame([("EUR", 1.1), ("JPY", 0.007)], "currency string, usd_per_unit double").write.parquet(f"{tmp_path}/currency_rates.parquet")
    got = {(r.parent_asin, r.quantity): r for r in quantities.p4_units(spark, str(tmp_path)).collect()}
    assert {a for a, q in got if q == "price"} == {f"A{i:03}" for i in range(200)} | {"U", "V"} and got["V", "weight"].amount == 2000
    assert (got["A001", "price"].unit, got["A001", "price"].amount) == ("EUR", 5610) and got["A000", "price"].unit == "JPY minor"
    for a in "UV":
        r = got[a, "price"]
        assert r.source == "review" and r.unit is None and r.amount is None or r.source == "predicted" and r.amount is not None


def test_constraint_rank_of_every_candidate(spark, tmp_path):
    """Candidates without a usable score are ranked by what they match; brand, budget and popularity count."""
    candidates = [(1, "A", 1, {"bm25": 2.0}), (1, "B", 2, None), (1, "C", 3, {}), (1, "D", 4, {"bm25": float("nan")})]
    meta = {"A": {"store": "Puma", "price": 90.0, "popularity": 4.0}, "B": {"store": "Nike Store", "price": 50.0}, "C": {"store": "", "price": 60.0, "popularity": 2.0}}
    folder = write(spark, tmp_path, [(1, "nike under $50")], candidates, meta)
    got = {r.parent_asin: (r.matched, r.violated, r.rank, r.score) for r in pool.constraint_rank(spark, folder).collect()}
    prior = lambda share: 0.008 * share / 3
    assert got == {"B": (2, 0, 1, round(0.4 + prior(1), 9)), "D": (0, 0, 2, round(prior(1), 9)), "C": (0, 1, 3, round(-0.1 + prior(0.5), 9)), "A": (0, 2, 4, round(round(1 / 61, 9) - 0.2 + prior(1), 9))}
    assert [tuple(r) for r in dialogue.rank_sensitivity(spark, folder).collect()] == [(1, 1, 3)]
