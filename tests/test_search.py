import math
import re

from pyspark.sql import functions as F

from weftline.functions import extract, text
from weftline.operators import catalog, metrics, search
from weftline.streaming.windows import hourly

ITEM = ("parent_asin string, title string, categories array<string>, features array<string>, details map<string,string>, store string, "
        "description array<string>, price double, average_rating double, rating_number bigint")
ITEMS = [
    ("A", "Blue running shoe", ["Clothing", "Shoes"], ["breathable mesh"], {"department": "womens"}, "Acme", [], 49.0, None, 3),
    ("B", "Red cotton shirt", ["Clothing", "Shirts"], [], {}, "", [], None, None, None),
    ("C", "Blue denim shirt, size XL", None, None, None, None, None, float("nan"), None, 0),
    ("D", None, [], [], {}, "", [], None, None, -1),
]


def products(spark):
    return spark.createDataFrame(ITEMS + [ITEMS[0]], ITEM)


def test_products_and_signals(spark):
    p = catalog.products(products(spark))
    assert p.count() == 4
    s = {r.parent_asin: r for r in catalog.signals(p).collect()}
    assert s["A"].colors == ["blue"] and s["A"].materials == ["mesh"] and s["A"].price == 49.0 and round(s["A"].popularity, 6) == round(math.log1p(3), 6)
    assert s["B"].popularity is None and s["C"].popularity == 0.0 and s["C"].price is None and s["C"].sizes == ["xl"] and s["D"].popularity is None
    assert catalog.popularity_scale(catalog.signals(p)).collect()[0].median == round(math.log1p(3), 9)
    assert catalog.coverage(catalog.signals(p).limit(0)).count() == 0


def test_bm25_against_brute_force(spark):
    p = catalog.products(products(spark))
    queries = spark.createDataFrame([(1, "blue shirt please"), (2, None), (3, "zzz")], "q int, t string")
    got = {(r.q, r.parent_asin): r.score for r in search.bm25(search.query_terms(queries, "q", "t"), "q", search.Index(p)).collect()}
    docs = {}
    for row in ITEMS:
        fields = {"title": row[1], "categories": row[2], "features": row[3], "details": row[4] and [f"{k} {v}" for k, v in row[4].items()], "store": row[5], "description": row[6]}
        docs[row[0]] = {f: re.findall(r"\w+", (v if isinstance(v, str) else " ".join(v or [])).lower()) if v else [] for f, v in fields.items()}
    mean = sum(len(t) for d in docs.values() for t in d.values()) / len(docs)
    expected = {}
    for term in ("blue", "shirt"):
        n = sum(any(term in t for t in d.values()) for d in docs.values())
        idf = max(math.log((4 - n + 0.5) / (n + 0.5)), 0) or 1e-6
        for k, d in docs.items():
            tf = sum(catalog.FIELDS[f] * t.count(term) for f, t in d.items())
            if tf:
                expected[1, k] = expected.get((1, k), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(map(len, d.values())) / mean))
    assert got.keys() == expected.keys() and all(abs(got[k] - round(v, 6)) < 2e-6 for k, v in expected.items())


def test_fusion_order_and_cap(spark):
    rows = [(1, "bm25", f"P{i:03}", 1.0, i) for i in range(1, 301)] + [(1, "category", "X", 5.0, 1), (1, "dense", "Y", 5.0, 1)]
    fused = search.fuse(spark.createDataFrame(rows, "q int, route string, parent_asin string, score double, rank int"), "q", ["bm25", "category"]).orderBy("pool_pos").collect()
    assert len(fused) == 300 and [r.parent_asin for r in fused[:3]] == ["P001", "X", "Y"] and fused[1].route_scores == {"category": 5.0}


def test_order_does_not_depend_on_partitions(spark):
    p = catalog.products(products(spark))
    terms = search.query_terms(spark.createDataFrame([(1, "blue shirt")], "q int, t string"), "q", "t")
    results = [sorted(map(tuple, search.top(search.bm25(terms, "q", search.Index(p.repartition(n))), "q", 10).collect())) for n in (1, 7, 64)]
    assert results[0] == results[1] == results[2]


def test_category_route_against_brute_force(spark):
    """Terms, beginnings and category beginnings each count as phrases; only products with a category phrase come out."""
    rows = [("A", "blue shirts shirt", ["Shirts", "Tops"]), ("B", "shirt", ["Hats"]), ("C", "plain", ["Shirt"]), ("D", "blue hat", ["Hats"]), ("E", None, None)]
    items = spark.createDataFrame([(a, t, c, None, None, None, None) for a, t, c in rows], "parent_asin string, title string, categories array<string>, features array<string>, details map<string,string>, store string, description array<string>")
    queries = spark.createDataFrame([(1, ["blue", "shirt"], ["blue"], ["shirt"]), (2, ["blue"], [], []), (3, ["zzz"], [], ["zzz"])], "q int, said array<string>, named array<string>, stems array<string>")
    got = {(r.q, r.parent_asin): r.score for r in search.category_bm25(search.category_phrases(queries, "q"), "q", search.Index(items)).collect()}
    docs = {a: {"title": (t or "").split(), "categories": [x.lower() for x in c or []]} for a, t, c in rows}
    mean = sum(len(t) for d in docs.values() for t in d.values()) / len(docs)
    weights = {"title": 6.0, "categories": 4.0}
    want: dict = {}
    for test, fields in ((lambda w: w == "blue", weights), (lambda w: w == "shirt", weights), (lambda w: w.startswith("shirt"), weights), (lambda w: w.startswith("shirt"), {"categories": 4.0})):
        hits = {k: tf for k, d in docs.items() if (tf := sum(v * sum(map(test, d[f])) for f, v in fields.items()))}
        idf = max(math.log((5 - len(hits) + 0.5) / (len(hits) + 0.5)), 0) or 1e-6
        for k, tf in hits.items():
            want[k] = want.get(k, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(map(len, docs[k].values())) / mean))
    assert got.keys() == {(1, "A"), (1, "C")} and all(abs(got[1, k] - want[k]) < 2e-6 for k in "AC")


def test_nearest_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(4)
    monkeypatch.setattr(search, "BLOCK", 3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)] + [(200, [0.0] * 5), (201, None), (202, [1.0, 2.0]), (203, [2.0, 4.0])]
    got = [tuple(r) for r in search.nearest(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(5), F.col("vec_id") % 10 == 0, 4).select("vec_id", "neighbour", "rank").collect()]
    exact = {r.vec_id: r.embedding for r in spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").collect() if r.embedding}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for q in range(0, 150, 10):
        near = sorted((-round(dot(exact[q], v) / math.sqrt(dot(v, v) * dot(exact[q], exact[q])), 6), i) for i, v in exact.items() if i != q and len(v) == 5 and any(v))
        want += [(q, i, r) for r, (_, i) in enumerate(near[:4], 1)]
    assert sorted(got) == sorted(want)


def test_prefixes(spark):
    d = spark.createDataFrame([("shoes",), ("shoe",), ("show",), ("sh",), ("xshoe",)], "term string")
    s = spark.createDataFrame([(1, "shoe"), (2, "sh"), (3, "zz")], "q int, stem string")
    got = {(r.q, r.term) for r in search.prefix_terms(s, "q", d).collect()}
    assert got == {(1, "shoes"), (1, "shoe"), (2, "shoes"), (2, "shoe"), (2, "show"), (2, "sh")}


def test_extraction(spark):
    def one(message, column):
        return spark.createDataFrame([(message,)], "m string").select(column(F.col("m")).alias("x")).first().x

    assert one("Grey or red wool coats, size x-large", extract.colours) == ["gray", "red"]
    assert one("Grey or red wool coats, size x-large", extract.size) == "xl" and one("a trainers", extract.category) == "sneakers"
    assert tuple(one("between $20 to $10", extract.budget)) == (10.0, 20.0) and tuple(one("over 50", extract.budget)) == (50.0, None)
    assert one("new levis please", extract.brand) == "levi" and one("unikely brandx", extract.brand) is None
    assert one(None, text.search_terms) == [] and one(None, extract.budget) is None and one("use your judgment", extract.is_non_answer)


def test_metrics(spark):
    v = spark.createDataFrame([("a", "x", True, 2, 2, 0.5), ("b", "x", False, None, None, 0.0)], "sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")
    r = metrics.summary(v).first()
    assert (r.hit_rate, r.mrr, r.mttc) == (0.5, 0.25, 6.5)
    empty = metrics.summary(v.limit(0)).first()
    assert (empty.sessions, empty.hit_rate, empty.mttc) == (0, 0.0, None)
    pairs = spark.createDataFrame([(False, True)] * 8 + [(True, False)] * 2 + [(True, True)] * 5, "b boolean, a boolean")
    assert tuple(metrics.mcnemar(pairs, "b", "a").first()) == (8, 2, 0.109375)
    assert metrics.mcnemar(pairs.limit(0), "b", "a").first().p == 1.0
    flips = spark.createDataFrame([(i, 1.0) for i in range(20)], "k int, d double")
    assert metrics.sign_flips(flips, "k", "d", 640).first().p < 0.01
    stats = metrics.order_statistics(spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)] + [("g", None)], "g string, v int"), "g", "v").first()
    assert (stats.mean, stats.median, stats.p90, stats.highest) == (2.5, 3, 4, 4)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:{i % 60:02}:00", "click" if i % 2 else "view", float(i)) for i in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double").selectExpr(
        "event_id", "cast(ts as timestamp) ts", "event_type", "value").repartition(3).write.parquet(str(tmp_path / "events"))
    from weftline.streaming.windows import read_events

    query = hourly(read_events(spark, str(tmp_path / "events"), 1), late="10 days").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(spark.read.parquet(str(tmp_path / "events"))).collect()))
