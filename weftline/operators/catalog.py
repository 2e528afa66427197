"""The catalogue as the search pipeline sees it: one row per product, its searchable text, and signals for ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.operators.prefix import below_each
from weftline.functions.text import all_terms, clean, empty, flatten_array, flatten_map, search_terms, stem, strings  # noqa: F401

#: Colours and materials that the ranker knows, with the spelling a colour is counted under.
COLOURS = (
    "black white blue navy red pink green olive brown tan beige gray grey silver gold purple violet yellow orange maroon teal cream "
    "ivory khaki burgundy charcoal turquoise coral lavender").split()
MATERIALS = (
    "cotton polyester nylon leather wool cashmere silk linen denim spandex elastane rayon suede fleece velvet satin chiffon corduroy "
    "canvas merino acrylic microfiber mesh flannel tweed jersey").split()

#: Weights of the indexed fields, in the order they are read.
FIELDS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}

#: Fixed value: size as catalogue texts write it.
SIZE = r"\bsize\b[:\s]*([0-9]{1,2}(?:\.5)?|xxs|xs|s|m|l|xl|xxl|xxxl)\b"


#: Preference tags and the trait words of products that meet them.
TAG_TRAITS = {
    "warmth": ["warm", "insulated", "thermal", "fleece", "sherpa", "winter", "cozy"],
    "weather": ["waterproof", "water", "resistant", "rain", "windproof", "weatherproof"],
    "performance": ["athletic", "performance", "training", "sport", "running", "workout", "wicking", "breathable"],
    "durability": ["durable", "rugged", "reinforced", "sturdy", "heavy", "lasting"],
    "comfort": ["comfortable", "comfort", "soft", "cushioned", "padded", "lightweight"],
}


def products(items: DataFrame) -> DataFrame:
    """One row per ``parent_asin``. Repeated rows are unchanged copies, so any of them stands for all."""
    return items.dropDuplicates(["parent_asin"])


def last_lines(raw: DataFrame) -> DataFrame:
    """The last received valid line of each product: re-sent lines replace earlier ones, broken ones count for nothing."""
    parsed = raw.withColumn("record", F.try_parse_json("raw_line")).withColumn("parent_asin", F.try_variant_get("record", "$.parent_asin", "string"))
    latest = Window.partitionBy("parent_asin").orderBy(F.desc("received_at"), F.desc("line_no"))
    return parsed.filter(F.col("parent_asin").isNotNull()).withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n", "record")


def field_texts(p: DataFrame) -> dict[str, Column]:
    return {
        "title": F.coalesce(F.col("title"), F.lit("")), "categories": flatten_array("categories"), "features": flatten_array("features"),
        "details": flatten_map("details"), "store": F.coalesce(F.col("store"), F.lit("")), "description": flatten_array("description")}


def searchable_text(p: DataFrame) -> Column:
    """All fields in fixed order, joined by blanks."""
    t = field_texts(p)
    return F.concat_ws(" ", *[t[f] for f in ("title", "features", "details", "description", "categories", "store")])


def signals(p: DataFrame) -> DataFrame:
    """Colours, materials, category tokens, store, sizes, price and popularity of each product; sets are sorted arrays.

    Empty sets mean unknown. A missing rating count gives a null popularity, which isn't the popularity of a count of 0.
    """
    text = F.lower(F.concat_ws(" ", *[field_texts(p)[f] for f in ("title", "categories", "store", "features", "details", "description")]))
    tokens = F.regexp_extract_all(text, F.lit("[a-z0-9.]+"), F.lit(0))
    one = lambda a: F.array_sort(F.array_distinct(a))
    return p.select(
        "parent_asin",
        one(F.transform(F.array_intersect(tokens, strings(*COLOURS)), lambda c: F.when(c == "grey", "gray").otherwise(c))).alias("colors"),
        one(F.array_intersect(tokens, strings(*MATERIALS))).alias("materials"),
        one(F.regexp_extract_all(F.lower(flatten_array("categories")), F.lit("[a-z0-9.]+"), F.lit(0))).alias("cats"),
        F.lower(F.coalesce("store", F.lit(""))).alias("store"),
        one(F.regexp_extract_all(text, F.lit(SIZE), F.lit(1))).alias("sizes"),
        F.when(~F.isnan("price"), F.col("price")).alias("price"),
        popularity("rating_number").alias("popularity"))


def product_meta(p: DataFrame) -> DataFrame:
    """Signals with ``traits``, the words of preference tags a product's texts have, and ``vocab``, its terms separated by blanks."""
    from weftline.operators.vocabulary import product_terms

    text = F.lower(F.concat_ws(" ", *[field_texts(p)[f] for f in ("title", "categories", "store", "features", "details", "description")]))
    tokens = F.regexp_extract_all(text, F.lit("[a-z0-9.]+"), F.lit(0))
    words = strings(*dict.fromkeys(w for ws in TAG_TRAITS.values() for w in ws))
    more = p.select("parent_asin", F.array_sort(F.array_distinct(F.array_intersect(tokens, words))).alias("traits"), F.concat_ws(" ", product_terms(p)).alias("vocab"))
    return signals(p).join(more, "parent_asin")


def popularity(count: str) -> Column:
    """``log1p`` of a count; null for a missing or negative one."""
    return F.when(F.col(count) >= 0, F.log1p(count))


def popularity_scale(s: DataFrame) -> DataFrame:
    """Maximum and upper median of the known popularities.

    The median is found by counting from distinct values, in steps of their scale, so that neither a list nor a window of all
    values is made.
    """
    counts = s.filter(F.col("popularity").isNotNull()).groupBy("popularity").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.max("popularity").alias("highest"))
    placed = below_each(counts, "popularity", "n", "below").crossJoin(F.broadcast(total))  # one row
    middle = placed.filter((F.col("below") <= F.floor(F.col("all") / 2)) & (F.col("below") + F.col("n") > F.floor(F.col("all") / 2)))
    found = middle.agg(F.min("popularity").alias("median"), F.max("highest").alias("highest"))
    return found.select(F.round("highest", 9).alias("highest"), F.round("median", 9).alias("median"))


def coverage(s: DataFrame) -> DataFrame:
    """Per slot the share of products with a value; no products give no rows."""
    filled = {"category": F.size("cats") > 0, "brand": F.col("store") != "", "material": F.size("materials") > 0,
              "color": F.size("colors") > 0, "size": F.size("sizes") > 0, "budget": F.col("price").isNotNull()}
    row = s.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in filled.items()])
    return row.filter("n > 0").select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("slot"), F.round(F.col(k) / F.col("n"), 9).alias("coverage"),
                 F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col(k) / F.col("n"))), 9).alias("reliability")) for k in filled])))
