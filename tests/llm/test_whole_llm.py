"""Products and rankings whatever the share or number of rows."""

from weftline.llm import fused_ranking, same_product


def test_a_third_of_all_rows_is_one_product(spark):
    """A product with a third of all rows keeps its model words, as they are those of one brand only."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rest = [(f"X{b}{m}{k}", f"Brandon{b}x Mod{b}{m}en Qu{m}{b}or shirt premium red", [f"by Brandon{b}x"]) for b in letters for m in letters[:10] for k in (0, 1)]
    hot = [(f"H{i:03}", "Zenix Tarlo Vimek shirt red" if i % 3 else "premium shirt red Tarlo Vimek", ["by Zenix"] if i % 3 else []) for i in range(260)]
    items = spark.createDataFrame([(*r, None, None, "s") for r in rest + hot], "parent_asin string, title string, features array<string>, description array<string>, details map<string,string>, store string")
    brands, common = ({r.w for r in t.collect()} for t in same_product.roles(same_product.facts(items)))
    assert "zenix" in brands and {"shirt", "premium"} <= common and not {"tarlo", "vimek"} & common
    clusters = {r.parent_asin: r["product"] for r in same_product.cluster(items).collect()}
    assert len({clusters.get(a) for a, *_ in hot}) == 1 and None not in {clusters.get(a) for a, *_ in hot}


def test_flip_does_not_depend_on_the_number_of_rows(spark):
    """Builds by correlation: weak in many rows isn't upside down, clear in few rows is."""
    def logged(tag, n, weight):
        return [(tag, True, weight * i / n + (1 - weight) * (i * 7919 % n) / n, i) for i in range(n)]

    rows = logged("weak", 20_011, 0.05) + logged("clear", 41, 0.6)
    ranked = spark.createDataFrame(rows, "build_tag string, h0 boolean, r0 double, pool_pos int")
    assert fused_ranking.logged_signs(ranked, 2) == {"weak": [1, 1], "clear": [-1, 1]}
