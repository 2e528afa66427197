import math
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import distinctive, encoding, fused_ranking, mixing, residue, same_product

DOCS = "doc_id bigint, text string, source string, lang string"


def test_tf_idf_against_brute_force(spark):
    random.seed(3)
    records = [(f"R{i}", [random.choice("abcdefgh") for _ in range(random.randint(0, 9))] + ["all"]) for i in range(60)] + [("E", []), ("N", None)]
    df = spark.createDataFrame(records, "id string, terms array<string>").selectExpr("*", "'x' AS term", "1.0 AS score")
    df_count = Counter(t for _, ts in records for t in set(ts or []))
    for hot in (1, 5, 20_000):
        got = {(r.id, r.term): (r.tf, r.df, r.score) for r in distinctive.tf_idf(df, "id", "terms", 62, hot).collect()}
        expected = {(i, t): (ts.count(t), df_count[t], ts.count(t) / len(ts) * math.log(63 / (1 + df_count[t]))) for i, ts in records if ts for t in set(ts)}
        assert got.keys() == expected.keys()
        assert all(g[:2] == e[:2] and abs(g[2] - e[2]) < 1e-8 for g, e in ((got[k], expected[k]) for k in got))
    assert distinctive.tf_idf(df.limit(0), "id", "terms", 0).count() == 0


def test_listing_terms_repeats_and_nulls(spark):
    items = spark.createDataFrame([("A", "Blue Shoe"), ("A", "Blue Shoe"), ("B", None)], "parent_asin string, title string")
    meta = spark.createDataFrame([("A", "shoe x-y"), ("B", None)], "parent_asin string, vocab string")
    got = {r.parent_asin: r.terms for r in distinctive.listing_terms(items, meta).collect()}
    assert got == {"A": ["blue", "shoe", "shoe", "x-y"], "B": []}


def candidates(spark, rows):
    return spark.createDataFrame(rows, "request_id bigint, parent_asin string, route_scores map<string,double>, pool_pos int, build_tag string")


def test_ranking_is_free_of_scale_and_sign_and_alike_on_both_paths(spark):
    random.seed(4)
    rows, meta = [], []
    for q in range(12):
        for i in range(30):
            x = random.gauss(0, 1)
            scores = {"bm25": (x + random.gauss(0, 0.3)) * (-50 if q % 2 else 1), "dense": x + random.gauss(0, 0.3) if i % 5 else None, "category": float("nan") if i == 3 else round(x) * 1e6}
            rows.append((q, f"P{i:02}", {k: v for k, v in scores.items() if i or k != "category"}, int(30 - 8 * x), "odd" if q % 2 else "even"))
    rows += rows[:5] + [(99, "lonely", {}, 1, None), (99, "null", None, 2, None)]
    meta = spark.createDataFrame([(f"P{i:02}", float(i) if i % 4 else None) for i in range(30)], "parent_asin string, popularity double")
    small, learned = fused_ranking.fuse(candidates(spark, rows), meta)
    large, _ = fused_ranking.fuse(candidates(spark, rows), meta, large=3)
    assert {x["score"]: x["upside_down"] for x in learned} == {"bm25": ["odd"], "category": [], "dense": [], "popularity": []}
    a, b = (sorted((r.request_id, r["rank"], r.parent_asin, round(r.score, 6)) for r in x.collect()) for x in (small, large))
    assert a == b and len(a) == 12 * 30 + 2
    scaled = [(q, p, s and {k: v if v is None else v * 1000 for k, v in s.items()}, pos, t) for q, p, s, pos, t in rows]
    c = fused_ranking.fuse(candidates(spark, scaled), meta)[0]
    assert sorted((r.request_id, r["rank"], r.parent_asin) for r in c.collect()) == [x[:3] for x in a]
    assert fused_ranking.fuse(candidates(spark, rows).limit(0), meta)[0].count() == 0


def test_first_component_matches_numpy(spark):
    rng = np.random.default_rng(0)
    base = rng.random(400)
    m = np.column_stack([base + rng.random(400) * s for s in (0.1, 0.5, 1.0)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "x0 double, x1 double, x2 double")
    loadings = fused_ranking.first_component(df, 3)[2]
    assert np.allclose(loadings, np.abs(np.linalg.eigh(np.corrcoef(m.T))[1][:, -1]), atol=1e-6)


ODD = ["", " ", "it's 'll don't\n\n x1y 12,5 ", "naïve 軽くて 👟👟 <|endoftext|>", "a" * 3000, "ab1" * 2000, " \t\n " * 50 + "x", "word " * 900]


def test_encoding_round_trip_and_cuts(spark):
    enc = encoding.load(f"{encoding.TOKENIZERS}/{encoding.RANKS}")
    for t in ODD:
        assert encoding.encode(enc, t, long=40) == enc.encode_ordinary(t)
        assert "".join(encoding.safe_pieces(t, 40)) == t
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate([*ODD, None])], DOCS)
    rows = encoding.encode_column(df, keep=("doc_id", "text")).withColumn("back", encoding.decode_column("ids")).collect()
    assert len(rows) == len(ODD) + 1 and all(bytes(r.back).decode() == (r.text or "") for r in rows)
    assert all(r.ids == [] for r in rows if not r.text)
    assert encoding.encode_column(df.limit(0)).count() == 0


def test_mixture_reaches_shares_and_caps(spark):
    docs = [(i, f"word{i} " * (5 + i % 7), ("big" if i % 10 else " Small-One "), None) for i in range(600)] + [(9000, None, "big", None), (9001, "", "big", None), (9002, "x", None, None)]
    df = spark.createDataFrame(docs, DOCS)
    plan = [(1, "big", 0.7, 3, 0.5), (1, "small_one", 0.3, 4, 0.5), (2, "small one", 0.5, 2, 1.0), (2, "big", 0.4, 2, 1.0), (2, "nobody", 0.1, 5, 1.0)]
    targets = spark.createDataFrame(plan, "plan_id int, source_name string, target_share double, max_repeats int, size_factor double")
    shares = {(r.plan_id, r.source): r for r in mixing.shares(df, targets).collect()}
    assert abs(shares[1, "big"].actual_share - 0.7) < 0.01 and abs(shares[1, "small_one"].actual_share - 0.3) < 0.01
    assert shares[2, "small_one"].repeats == 2 and shares[2, "small_one"].used_tokens == 2 * shares[2, "small_one"].held_tokens
    assert shares[2, "nobody"].used_tokens == 0
    rows = mixing.mixture(df, targets).collect()
    uses = Counter((r.plan_id, r.doc_id) for r in rows)
    assert max(n for (p, _), n in uses.items() if p == 2) <= 2 and not {9000, 9001, 9002} & {r.doc_id for r in rows}
    one = [r for r in rows if r.plan_id == 1]
    assert [r.position for r in one] == sorted(r.position for r in one) and 0 <= one[0].position and one[-1].position <= 1
    tokens = sum(r.tokens for r in one)
    first = sum(r.tokens for r in one if r.position < 0.5)
    assert abs(first / tokens - 0.5) < 0.03  # positions keep the pace of the tokens
    early = sum(r.tokens for r in one if r.source == "big" and r.position < 0.5) / first
    assert early > 0.705  # and the schedule is felt: "big" comes first in the names' order
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_residue(spark):
    colours = ["black", "red", "teal", "olive", "white"]
    real = [f"The {c} strap needed one small adjustment. Returns took {i} days and the refund arrived." for i, c in enumerate(colours * 6)]
    decoys = ["The risk of snagging is close to null with this weave. Returns took 3 days and the refund arrived.",
              "The size chart only opened after I enabled JavaScript. The red strap needed one small adjustment.",
              "The size chart only opened after I enabled JavaScript. Returns took 9 days and the refund arrived."] * 3
    slots = ["The {{ item.color }} strap needed one small adjustment. Returns took 4 days and the refund arrived.",
             "The red strap needed one small adjustment. Returns took undefined days and the refund arrived.",
             "The [INSERT COLOR] strap needed one small adjustment."]
    pages = ["Please enable JavaScript to view this page.", "Acme Goods\nPlease enable JavaScript to view this page. Then refresh the page.",
             "Your browser is not supported. Then refresh the page.", "404 - Page not found Go back", "<p>Page not found</p>",
             "Ut labore dolor lorem ipsum magna. Sed do eiusmod tempor."] * 2
    texts = [*real, *decoys, *slots, *pages, None, "", "  \n"]
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], DOCS).selectExpr("*", "'x' AS kind", "1 AS doc", "'y' AS key")
    got = {r.doc_id: r.kind for r in residue.find_residue(df).collect()}
    at = len(real) + len(decoys)
    assert got == {at + i: "slot" if i < len(slots) else "page" for i in range(len(slots) + len(pages))}
    assert residue.without_residue(df).count() == len(texts) - len(got)
    assert residue.find_residue(df.limit(0)).count() == 0


ITEMS = "parent_asin string, title string, features array<string>, description array<string>, details map<string,string>, store string"


def test_same_product(spark):
    filler = ["shirt premium", "boots classic", "scarf", "watch new", "belt trendy"]
    items = []
    for b in range(30):
        for m in range(8):
            model = f"Mod{chr(97 + b % 26)}{chr(97 + m)}en Qu{chr(97 + m)}{chr(97 + b % 26)}or"
            for k in range(2):
                items.append((f"X{b:02}{m}{k}", f"Brandon{chr(97 + b % 26)}x {model} {filler[b % 5]} colour red", [f"by Brandon{chr(97 + b % 26)}x"], [], {}, "s"))
    extra = [
        ("A1", "Zenix Tarlo Vimek watch 52mm red", ["by Zenix"], [], {}, "s"), ("A2", "ZENIX - Tarlo-Vimek - 5.2 cm - cherry red - watch", None, None, None, None),
        ("A3", "watch TarloVimek red Zenix", ["Model TV8K2PX"], [], {"Case Diameter": "52 mm"}, "s"), ("A4", "Zenix watch", ["Style tv-8k2px"], [], {}, "s"),
        ("A5", "Zenix Tarlo Vimmek watch red 2.0\"", ["Brand: Zenix"], [], {}, "s"), ("B1", "Zenix Tarlo Vimek II watch 52mm red", ["by Zenix"], [], {}, "s"),
        ("B2", "Zenix Tarlo Vimek watch 44mm red", ["by Zenix"], [], {}, "s"), ("B3", "Zenix Tarlo Vimek watch 52mm black", [], [], {}, "s"),
        ("B4", "Zenix Tarlo Vimek watch 52mm red Pack of 2", [], [], {}, "s"), ("N", None, None, None, None, None)]
    df = spark.createDataFrame(items + extra + extra[:1], ITEMS)
    clusters = {r.parent_asin: r["product"] for r in same_product.cluster(df, 0.05).collect()}
    assert len({clusters[a] for a in ("A1", "A2", "A3", "A4", "A5")}) == 1
    assert len({clusters[a] for a in ("A1", "B1", "B2", "B3", "B4")}) == 5 and "N" not in clusters
    pairs = {tuple(r) for r in same_product.same_pairs(same_product.cluster(df.filter("parent_asin like 'A%' or parent_asin like 'B%' or parent_asin like 'X%'"), 0.05)).collect()}
    assert ("A1", "A2") in pairs and all(a < b for a, b in pairs)


@pytest.mark.parametrize("title, expected", [
    ("Acme 3-Pack ring", 3), ("ring Pack of 2", 2), ("ring 4 pcs.", 4), ("ring", 1)])
def test_packs(title, expected):
    assert same_product.read_listing(title, None, None, None)[3] == expected


def test_same_product_of_nothing(spark):
    assert same_product.cluster(spark.createDataFrame([], ITEMS)).count() == 0
