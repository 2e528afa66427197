"""Terms of a pool of candidates: document frequencies, the rerank they weigh, discriminating terms, and grounding of free words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.text import flatten_array, search_terms, strings

#: Terms kept of a product; least pool for frequency bounds; least frequency, largest share, most terms of a pool; least support.
TERMS, LEAST_POOL, LEAST_DF, LARGEST_SHARE, MOST_TERMS, LEAST_SUPPORT = 40, 8, 2, 0.8, 1500, 0.05

#: Words that describe a listing and not the product.
LISTING_WORDS = (
    "imported", "manufacturer", "discontinued", "asin", "dimensions", "inches", "ounces", "pounds", "package", "packaging", "item", "model",
    "number", "date", "available", "department", "shipping", "returns", "warranty", "amazon", "seller", "please", "click", "buy", "purchase",
    "customer", "service", "contact", "email", "guarantee", "satisfaction", "quality", "products", "product", "brand", "new", "free", "day", "days",
    "size", "sizes", "chart", "check", "note", "due", "may", "vary", "different", "monitor", "screen", "picture", "actual", "color", "hand",
    "machine", "wash", "washable", "dry", "clean", "cleaning", "care", "instructions", "bleach", "iron", "tumble", "only", "made", "usa", "material",
    "materials", "made-in", "occasion", "suitable")

#: shoppers' words and the words catalogues use for them.
GROUNDING = {
    "warm": ["insulated", "thermal", "fleece", "sherpa", "quilted", "down", "wool", "lined", "padded", "warmth"],
    "warmth": ["insulated", "thermal", "fleece", "wool", "lined", "padded"],
    "cold": ["insulated", "thermal", "fleece", "wool", "windproof"],
    "winter": ["insulated", "thermal", "fleece", "wool", "down", "parka"],
    "summer": ["breathable", "lightweight", "mesh", "linen", "short", "airy"],
    "cool": ["breathable", "mesh", "ventilated", "lightweight"],
    "comfortable": ["soft", "stretch", "cushioned", "padded", "breathable", "relaxed", "comfort"],
    "comfy": ["soft", "stretch", "cushioned", "padded", "relaxed", "comfort"],
    "soft": ["cotton", "fleece", "cashmere", "plush", "velvet", "brushed"],
    "lightweight": ["light", "breathable", "thin", "mesh", "packable"],
    "breathable": ["mesh", "ventilated", "moisture", "wicking", "airy"],
    "durable": ["reinforced", "ripstop", "rugged", "heavyweight", "sturdy", "resistant", "tear"],
    "waterproof": ["water", "resistant", "rain", "sealed", "repellent"],
    "stretchy": ["stretch", "spandex", "elastane", "elastic", "flexible"],
    "casual": ["everyday", "relaxed", "weekend"],
    "formal": ["dress", "business", "tailored", "suit", "professional"],
    "work": ["business", "office", "professional", "dress"],
    "gym": ["athletic", "performance", "training", "moisture", "wicking"],
    "workout": ["athletic", "performance", "training", "moisture", "wicking"],
    "hiking": ["trail", "outdoor", "traction", "rugged", "hike"],
    "travel": ["packable", "wrinkle", "lightweight", "compact"],
}


def product_terms(p: DataFrame) -> Column:
    """The first different terms of title, categories, features and description that name a product: letters only, three at least."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), flatten_array("categories"), flatten_array("features"), flatten_array("description"))
    kept = F.filter(search_terms(text), lambda t: (F.length(t) > 2) & ~t.rlike("[0-9]") & ~F.array_contains(strings(*LISTING_WORDS), t))
    return F.slice(F.array_distinct(kept), 1, TERMS)


def pool_members(candidates: DataFrame) -> DataFrame:
    """``request_id, parent_asin``, once each."""
    return candidates.select("request_id", "parent_asin").distinct()


def pool_frequencies(members: DataFrame, vocab: DataFrame) -> DataFrame:
    """``request_id, term, df, pool``: in how many products of a pool a term occurs. Partial counts are made before the shuffle."""
    sizes = members.groupBy("request_id").agg(F.count("*").alias("pool"))
    terms = members.join(vocab, "parent_asin").select("request_id", F.explode("terms").alias("term"))
    return terms.groupBy("request_id", "term").agg(F.count("*").alias("df")).join(sizes, "request_id")


def kept(frequencies: DataFrame) -> DataFrame:
    """Terms of neither one product nor nearly all; small pools keep all. At most ``MOST_TERMS`` a pool, the most frequent first."""
    bounded = frequencies.filter((F.col("pool") < LEAST_POOL) | ((F.col("df") >= LEAST_DF) & (F.col("df") <= F.col("pool") * LARGEST_SHARE)))
    order = Window.partitionBy("request_id").orderBy(F.desc("df"), "term")
    return bounded.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_TERMS).drop("n")


def idf_rerank(members: DataFrame, vocab: DataFrame, said: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``request_id, parent_asin, score`` of every member: summed ln(pool / (1 + df)) of the request's words that a product holds, else 0.

    Only words that the request says are taken out of a product, so that the others aren't shuffled.
    """
    weights = said.join(kept(frequencies), ["request_id", "term"]).withColumn("weight", F.log(F.col("pool") / (1.0 + F.col("df"))))
    asked = said.groupBy("request_id").agg(F.collect_set("term").alias("asked"))  # the words of one message
    holding = members.join(asked, "request_id").join(vocab, "parent_asin").select("request_id", "parent_asin", F.explode(F.array_intersect("terms", "asked")).alias("term"))
    scored = holding.join(weights, ["request_id", "term"]).groupBy("request_id", "parent_asin").agg(F.round(F.sum("weight"), 6).alias("score"))
    return members.join(scored, ["request_id", "parent_asin"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
