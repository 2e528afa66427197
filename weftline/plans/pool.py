"""Queries over the candidate pools of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.functions import extract
from weftline.functions.text import search_terms, stem
from weftline.operators import catalog, search, vocabulary
from weftline.operators.prefix import number_rows
from weftline.plans.messages import COLOUR_LIST, MATERIAL_LIST, MESSAGES_SQL, SIZE_SQL, SQL as MESSAGE_SQL, T_SQL, WORD_MAP, messages
from weftline.runtime import materialize, table

VOCAB_SQL = "vocab AS (SELECT parent_asin, list_distinct(regexp_extract_all(lower(vocab), '\\S+')) AS terms FROM catalog_meta WHERE vocab IS NOT NULL)"
MEMBERS_SQL = "members AS (SELECT DISTINCT request_id, parent_asin FROM candidates)"
DF_SQL = """frequencies AS (SELECT request_id, term, df, pool FROM (
  SELECT request_id, term, count(*) AS df FROM (SELECT request_id, unnest(terms) AS term FROM members JOIN vocab USING (parent_asin)) GROUP BY ALL)
  JOIN (SELECT request_id, count(*) AS pool FROM members GROUP BY request_id) USING (request_id))"""
KEPT_SQL = """kept AS (SELECT * FROM frequencies WHERE pool < 8 OR (df >= 2 AND df <= pool * 0.8)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY df DESC, term) <= 1500)"""


def meta_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "catalog_meta").filter(F.col("vocab").isNotNull())
    return meta.select("parent_asin", F.array_distinct(F.regexp_extract_all(F.lower("vocab"), F.lit(r"\S+"), F.lit(0))).alias("terms"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.pool_members(table(spark, sf_dir, "candidates"))


def meta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each candidate; a candidate without a row is unknown in all of them."""
    meta = table(spark, sf_dir, "catalog_meta").select("parent_asin", "colors", "materials", "cats", "store", "sizes", "price", "popularity")
    return members(spark, sf_dir).join(meta, "parent_asin", "left").withColumn("price", F.when(~F.isnan("price"), F.col("price")))


def pool_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of known terms of each candidate, null for unknown ones; only the term column is read."""
    return members(spark, sf_dir).join(meta_vocab(spark, sf_dir), "parent_asin", "left").select(
        "request_id", "parent_asin", F.when(F.col("terms").isNotNull(), F.size("terms")).cast("bigint").alias("n_terms"))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.pool_frequencies(members(spark, sf_dir), meta_vocab(spark, sf_dir))


def pool_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.kept(frequencies(spark, sf_dir))


def vocab_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pool how many terms are kept, too rare, too common, and beyond the most that a pool keeps."""
    f, big = frequencies(spark, sf_dir), F.col("pool") >= vocabulary.LEAST_POOL
    rare, common = big & (F.col("df") < vocabulary.LEAST_DF), big & (F.col("df") > F.col("pool") * vocabulary.LARGEST_SHARE)
    return f.groupBy("request_id").agg(F.count_if(rare).alias("rare"), F.count_if(common & ~rare).alias("common"), F.count_if(~rare & ~common).alias("held")).select(
        "request_id", "rare", "common", F.least("held", F.lit(vocabulary.MOST_TERMS)).cast("bigint").alias("kept"), F.greatest(F.col("held") - vocabulary.MOST_TERMS, F.lit(0)).cast("bigint").alias("over_limit"))


def most_discriminative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten terms of each pool that come nearest to splitting it in halves."""
    order = Window.partitionBy("request_id").orderBy(F.abs(F.col("df") / F.col("pool") - 0.5), F.desc("df"), "term")
    return pool_vocabulary(spark, sf_dir).withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("request_id", "term", "df", "rank")


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("request_id", F.explode(F.array_distinct(search_terms(F.col("user_message")))).alias("term"))


def pool_idf_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of each request, ranked by the rarity within the pool of the request's words they hold.

    A permutation of the pool: equal scores, those of 0 included, stay in incoming order, which is the best logged position,
    null ones last, then the id. A request without words in its pool's vocabulary keeps that order.
    """
    scored = vocabulary.idf_rerank(members(spark, sf_dir), meta_vocab(spark, sf_dir), said(spark, sf_dir), frequencies(spark, sf_dir))
    incoming = table(spark, sf_dir, "candidates").groupBy("request_id", "parent_asin").agg(F.min("pool_pos").alias("incoming"))
    placed = materialize(scored.join(incoming, ["request_id", "parent_asin"]), "placed")
    return number_rows(placed, "request_id", "score", [F.asc_nulls_last("incoming"), "parent_asin"], "rank").drop("incoming")


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each word of requests weighs over all pools."""
    w = said(spark, sf_dir).join(pool_vocabulary(spark, sf_dir), ["request_id", "term"])
    return w.groupBy("term").agg(F.count("*").alias("pools"), F.round(F.sum(F.log(F.col("pool") / (1.0 + F.col("df")))), 6).alias("weight"))


def grounding(spark: SparkSession) -> DataFrame:
    pairs = [(k, w) for k, words in vocabulary.GROUNDING.items() for w in words]
    return spark.createDataFrame(pairs, "said string, term string")


def grounding_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each pool that holds a catalogue word for something the request said."""
    asked = said(spark, sf_dir).withColumnRenamed("term", "said").join(F.broadcast(grounding(spark)), "said")
    return asked.join(pool_vocabulary(spark, sf_dir), ["request_id", "term"]).select(
        "request_id", "said", "term", F.round(F.col("df") / F.col("pool"), 6).alias("support"))


def ground_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue words for what a request said: its own words in the pool, and mapped ones with enough support."""
    own = said(spark, sf_dir).join(pool_vocabulary(spark, sf_dir), ["request_id", "term"]).select("request_id", F.col("term").alias("said"), "term")
    return own.unionByName(grounding_support(spark, sf_dir).filter(F.col("support") >= vocabulary.LEAST_SUPPORT).select("request_id", "said", "term")).distinct()


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the logged route scores."""
    c = table(spark, sf_dir, "candidates").select("request_id", "parent_asin", F.explode("route_scores").alias("route", "score"))
    c = c.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("request_id", "route", "parent_asin").agg(F.max("score").alias("score"))
    order = Window.partitionBy("request_id", "route").orderBy(F.desc("score"), "parent_asin")
    fused = search.fuse(c.withColumn("rank", F.row_number().over(order)), "request_id", ["bm25", "category", "attribute"])
    return fused.select("request_id", "parent_asin", "fusion_score", "pool_pos")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the message of each request alone asks for; ``weftline.plans.session`` has what a session has asked for so far."""
    m = F.col("user_message")
    return messages(spark, sf_dir).select(
        "request_id", extract.category(m).alias("asked_category"), extract.colours(m).alias("asked_colors"), extract.materials(m).alias("asked_materials"),
        extract.size(m).alias("asked_size"), extract.brand(m).alias("asked_brand"), extract.budget(m).alias("bounds"))


#: Slots that are judged.
SLOTS = ("category", "color", "material", "size", "brand", "budget")

#: Weights of matches and violations, and of the popularity prior in the message's own ranking.
MATCH, PENALTY, PRIOR = 0.4, 0.2, 0.008


def classify_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each candidate on each constraint of its request: match, violation, or unknown where the product says nothing."""
    return verdicts(spark, sf_dir).select("request_id", "parent_asin", *SLOTS)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its verdicts on all slots, null where nothing is asked, and its popularity. A brand is part of the store's name, bounds are inclusive."""
    meta = table(spark, sf_dir, "catalog_meta").select(
        "parent_asin", "colors", "materials", "cats", "sizes", F.lower("store").alias("store"), F.when(~F.isnan("price"), F.col("price")).alias("price"),
        F.when(~F.isnan("popularity"), F.col("popularity")).alias("popularity"))
    rows = members(spark, sf_dir).join(constraints(spark, sf_dir), "request_id").join(meta, "parent_asin", "left")
    known = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    stems = F.transform(F.split("asked_category", " "), stem)
    in_path = F.forall(stems, lambda s: F.exists("cats", lambda c: c.startswith(s)))
    outside = F.coalesce(F.col("price") < F.col("bounds.least"), F.lit(False)) | F.coalesce(F.col("price") > F.col("bounds.most"), F.lit(False))

    def verdict(asked, present, hit, strict=True):
        return F.when(asked, F.when(~present, "unknown").when(hit, "match").otherwise("violation" if strict else "unknown"))

    return rows.select(
        "request_id", "parent_asin", "popularity",
        verdict(F.col("asked_category").isNotNull(), known("cats"), in_path).alias("category"),
        verdict(F.size("asked_colors") > 0, known("colors"), F.arrays_overlap("asked_colors", "colors")).alias("color"),
        verdict(F.size("asked_materials") > 0, known("materials"), F.arrays_overlap("asked_materials", "materials")).alias("material"),
        verdict(F.col("asked_size").isNotNull(), known("sizes"), F.array_contains("sizes", F.col("asked_size")), strict=False).alias("size"),
        verdict(F.col("asked_brand").isNotNull(), F.coalesce(F.col("store") != "", F.lit(False)), F.contains("store", "asked_brand")).alias("brand"),
        verdict(F.col("bounds").isNotNull(), F.col("price").isNotNull(), ~outside).alias("budget"))


def constraint_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates ranked by fused score, constraint matches, violations and popularity. Verdicts are counted within the row, without a shuffle.

    A candidate without a usable route score has a fused score of 0. The popularity prior, over the scale's maximum and the
    median where unknown, fades with the number of constraints.
    """
    count = lambda v: sum((F.when(F.col(s) == v, 1).otherwise(0) for s in SLOTS), F.lit(0))
    asked = sum((F.col(s).isNotNull().cast("int") for s in SLOTS), F.lit(0))
    v = verdicts(spark, sf_dir).withColumn("asked", asked).withColumn("matched", count("match")).withColumn("violated", count("violation"))
    meta = table(spark, sf_dir, "catalog_meta").select(F.when(~F.isnan("popularity"), F.col("popularity")).alias("popularity"))
    fused = v.join(rrf_fusion(spark, sf_dir).drop("pool_pos"), ["request_id", "parent_asin"], "left").withColumn("fusion_score", F.coalesce("fusion_score", F.lit(0.0)))
    known = F.coalesce("popularity", "median", F.lit(0.5)) / F.coalesce("highest", F.lit(13.0))
    prior = PRIOR * F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), known)), F.lit(0.0)) / (1 + F.col("asked"))
    scored = fused.crossJoin(F.broadcast(catalog.popularity_scale(meta))).withColumn("score", F.round(  # one row
        F.col("fusion_score") + F.when(F.col("asked") > 0, (MATCH * F.col("matched") - PENALTY * F.col("violated")) / F.col("asked")).otherwise(0.0) + prior, 9))
    numbered = number_rows(materialize(scored, "scored"), "request_id", "score", [F.desc("fusion_score"), "parent_asin"], "rank")
    return numbered.select("request_id", "parent_asin", "score", "matched", "violated", "rank")


def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter of its pool's prices that each priced candidate falls in; pools of fewer than four prices have one.

    The quartiles are those of the exclusive method: the value at rank j (n + 1) / 4, interpolated. Ranks come from a window
    by pool; neighbours from the two rows around the rank.
    """
    meta = table(spark, sf_dir, "catalog_meta").filter(F.col("price").isNotNull() & ~F.isnan("price")).select("parent_asin", "price")
    priced = members(spark, sf_dir).join(meta, "parent_asin")
    pool = Window.partitionBy("request_id")
    ranked = priced.withColumn("i", F.row_number().over(pool.orderBy("price", "parent_asin"))).withColumn("n", F.count("*").over(pool))
    for j in (1, 2, 3):
        whole = F.greatest(F.lit(1), F.least(F.floor(j * (F.col("n") + 1) / 4), F.col("n") - 1))
        part = j * (F.col("n") + 1) / 4 - whole
        low, high = (F.max(F.when(F.col("i") == at, F.col("price"))).over(pool) for at in (whole, whole + 1))
        ranked = ranked.withColumn(f"q{j}", F.round(low + (high - low) * part, 9))
    bucket = sum((F.when(F.col("price") > F.col(f"q{j}"), 1).otherwise(0) for j in (1, 2, 3)), F.lit(0))
    return ranked.select("request_id", "parent_asin", "price", F.when(F.col("n") >= 4, bucket).otherwise(0).alias("bucket"))


def pool_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request: rows logged, different products, repeats, products without routes, and mean number of routes."""
    c = table(spark, sf_dir, "candidates")
    return c.groupBy("request_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("parent_asin").alias("products"),
        F.count_if(F.coalesce(F.size("route_scores"), F.lit(0)) <= 0).alias("without_routes"),
        F.round(F.avg(F.greatest(F.coalesce(F.size("route_scores"), F.lit(0)), F.lit(0))), 6).alias("mean_routes"))


def route_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per route how many (request, product) pairs it found, and how many only it found."""
    found = table(spark, sf_dir, "candidates").select("request_id", "parent_asin", F.explode(F.map_keys("route_scores")).alias("route")).distinct()
    alone = found.groupBy("request_id", "parent_asin").agg(F.count("*").alias("n"), F.min("route").alias("one"))
    only = alone.filter("n = 1").groupBy(F.col("one").alias("route")).agg(F.count("*").alias("n_only"))
    return found.groupBy("route").agg(F.count("*").alias("pairs")).join(only, "route", "left").withColumn("n_only", F.coalesce("n_only", F.lit(0)))


QUERIES = {f.__name__: f for f in (
    meta_lookup, pool_terms, pool_vocabulary, vocab_noise, most_discriminative, pool_idf_rerank, term_weights, grounding_support, ground_terms,
    rrf_fusion, classify_constraints, constraint_rank, price_buckets, pool_shape, route_presence)}

BASE = f"WITH {VOCAB_SQL}, {MEMBERS_SQL}, {DF_SQL}, {KEPT_SQL}, {MESSAGES_SQL}, said AS (SELECT DISTINCT request_id, unnest({T_SQL}) AS term FROM messages)"
MAP_ROWS = ", ".join(f"('{k}', '{w}')" for k, words in vocabulary.GROUNDING.items() for w in words)
SUPPORT = f"support AS (SELECT request_id, said, k.term AS term, round(df / pool, 6) AS support FROM (SELECT request_id, term AS said FROM said) JOIN (VALUES {MAP_ROWS}) m(said, term) USING (said) JOIN kept k USING (request_id, term))"
FUSED_SQL = """routes AS (SELECT request_id, route, parent_asin, max(score) AS score FROM (
    SELECT request_id, parent_asin, unnest(map_keys(route_scores)) AS route, unnest(map_values(route_scores)) AS score FROM candidates)
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, route ORDER BY score DESC, parent_asin) AS rank,
  coalesce(nullif(list_position(['bm25', 'category', 'attribute'], route), 0), 4) AS place FROM routes),
fused AS (SELECT request_id, parent_asin, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score, min(struct_pack(rank := rank, place := place)) AS best FROM ranked GROUP BY ALL),
pool AS (SELECT request_id, parent_asin, fusion_score, row_number() OVER (PARTITION BY request_id ORDER BY fusion_score DESC, best.rank, best.place, parent_asin)::INT AS pool_pos FROM fused QUALIFY pool_pos <= 300)"""
VERDICTS = f"""asked AS (SELECT request_id, list_filter(list_transform(t, lambda t: {WORD_MAP}[t]), lambda c: c IS NOT NULL)[1] AS a_category,
    list_distinct(list_transform(list_filter(t, lambda t: list_contains({COLOUR_LIST}, t)), lambda c: CASE WHEN c = 'grey' THEN 'gray' ELSE c END)) AS a_colors,
    list_distinct(list_filter(t, lambda t: list_contains({MATERIAL_LIST}, t))) AS a_materials FROM (SELECT request_id, {T_SQL} AS t FROM messages)),
sized AS (SELECT * FROM ({{size}})), branded AS ({MESSAGE_SQL['extract_brand']}), bounded AS ({MESSAGE_SQL['extract_budget']}),
verdicts_of AS (SELECT request_id, parent_asin,
  CASE WHEN a_category IS NOT NULL THEN CASE WHEN coalesce(len(cats), 0) = 0 THEN 'unknown' WHEN len(list_filter(list_transform(string_split(a_category, ' '),
    lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END), lambda s: len(list_filter(cats, lambda c: starts_with(c, s))) = 0)) = 0 THEN 'match' ELSE 'violation' END END AS category,
  CASE WHEN len(a_colors) > 0 THEN CASE WHEN coalesce(len(colors), 0) = 0 THEN 'unknown' WHEN list_has_any(a_colors, colors) THEN 'match' ELSE 'violation' END END AS color,
  CASE WHEN len(a_materials) > 0 THEN CASE WHEN coalesce(len(materials), 0) = 0 THEN 'unknown' WHEN list_has_any(a_materials, materials) THEN 'match' ELSE 'violation' END END AS material,
  CASE WHEN size IS NOT NULL THEN CASE WHEN coalesce(len(sizes), 0) > 0 AND list_contains(sizes, size) THEN 'match' ELSE 'unknown' END END AS size,
  CASE WHEN brand IS NOT NULL THEN CASE WHEN coalesce(store, '') = '' THEN 'unknown' WHEN contains(lower(store), brand) THEN 'match' ELSE 'violation' END END AS brand,
  CASE WHEN least IS NOT NULL OR most IS NOT NULL THEN CASE WHEN price IS NULL OR isnan(price) THEN 'unknown' WHEN price < least OR price > most THEN 'violation' ELSE 'match' END END AS budget
  FROM members JOIN asked USING (request_id) JOIN sized USING (request_id) JOIN branded USING (request_id) JOIN bounded USING (request_id) LEFT JOIN catalog_meta USING (parent_asin))"""


def _verdicts() -> str:
    return VERDICTS.replace("{size}", SIZE_SQL)


PRICE_SQL = f"""WITH {MEMBERS_SQL}, priced AS (SELECT request_id, parent_asin, price, row_number() OVER (PARTITION BY request_id ORDER BY price, parent_asin) AS i, count(*) OVER (PARTITION BY request_id) AS n
  FROM members JOIN (SELECT parent_asin, price FROM catalog_meta WHERE price IS NOT NULL AND NOT isnan(price)) USING (parent_asin)),
whole AS (SELECT *, greatest(1, least((1 * (n + 1)) // 4, n - 1)) AS w1, greatest(1, least((2 * (n + 1)) // 4, n - 1)) AS w2, greatest(1, least((3 * (n + 1)) // 4, n - 1)) AS w3 FROM priced),
q AS (SELECT *, """ + ", ".join(
    f"max(price) FILTER (i = w{j}) OVER p AS l{j}, max(price) FILTER (i = w{j} + 1) OVER p AS h{j}" for j in (1, 2, 3)) + """ FROM whole WINDOW p AS (PARTITION BY request_id))
SELECT request_id, parent_asin, price, CASE WHEN n >= 4 THEN """ + " + ".join(
    f"CASE WHEN price > round(l{j} + (h{j} - l{j}) * ({j} * (n + 1) / 4 - w{j}), 9) THEN 1 ELSE 0 END" for j in (1, 2, 3)) + " ELSE 0 END AS bucket FROM q"
SQL = {
    "meta_lookup": f"WITH {MEMBERS_SQL} SELECT m.request_id, m.parent_asin, colors, materials, cats, store, sizes, CASE WHEN NOT isnan(price) THEN price END AS price, popularity FROM members m LEFT JOIN catalog_meta USING (parent_asin)",
    "pool_terms": f"WITH {MEMBERS_SQL}, {VOCAB_SQL} SELECT request_id, parent_asin, len(terms) AS n_terms FROM members LEFT JOIN vocab USING (parent_asin)",
    "pool_vocabulary": f"{BASE} SELECT * FROM kept",
    "vocab_noise": f"{BASE} SELECT request_id, rare, common, least(held, 1500) AS kept, greatest(held - 1500, 0) AS over_limit FROM (SELECT request_id, count(*) FILTER (pool >= 8 AND df < 2) AS rare, count(*) FILTER (pool >= 8 AND df >= 2 AND df > pool * 0.8) AS common, count(*) FILTER (pool < 8 OR (df >= 2 AND df <= pool * 0.8)) AS held FROM frequencies GROUP BY request_id)",
    "most_discriminative": f"{BASE} SELECT request_id, term, df, row_number() OVER (PARTITION BY request_id ORDER BY abs(df / pool - 0.5), df DESC, term)::INT AS rank FROM kept QUALIFY rank <= 10",
    "pool_idf_rerank": f"""{BASE}, scored AS (SELECT request_id, parent_asin, round(sum(ln(pool / (1.0::DOUBLE + df))), 6) AS score FROM (SELECT request_id, parent_asin, unnest(terms) AS term FROM members JOIN vocab USING (parent_asin))
      JOIN said USING (request_id, term) JOIN kept USING (request_id, term) GROUP BY ALL), incoming AS (SELECT request_id, parent_asin, min(pool_pos) AS place FROM candidates GROUP BY ALL)
      SELECT request_id, parent_asin, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(score, 0) DESC, place NULLS LAST, parent_asin)::INT AS rank
      FROM incoming LEFT JOIN scored USING (request_id, parent_asin)""",
    "term_weights": f"{BASE} SELECT term, count(*) AS pools, round(sum(ln(pool / (1.0::DOUBLE + df))), 6) AS weight FROM said JOIN kept USING (request_id, term) GROUP BY term",
    "grounding_support": f"{BASE}, {SUPPORT} SELECT * FROM support",
    "ground_terms": f"{BASE}, {SUPPORT} SELECT request_id, term AS said, term FROM said JOIN kept USING (request_id, term) UNION SELECT request_id, said, term FROM support WHERE support >= 0.05",
    "rrf_fusion": f"WITH {FUSED_SQL} SELECT * FROM pool",
    "classify_constraints": f"WITH {MEMBERS_SQL}, {MESSAGES_SQL}, {_verdicts()} SELECT * FROM verdicts_of",
    "constraint_rank": f"""WITH {MEMBERS_SQL}, {MESSAGES_SQL}, {_verdicts()}, {FUSED_SQL}, counted AS (SELECT request_id, parent_asin,
      {' + '.join(f'({s} IS NOT NULL)::INT' for s in SLOTS)} AS asked, {' + '.join(f"coalesce({s} = 'match', false)::INT" for s in SLOTS)} AS matched, {' + '.join(f"coalesce({s} = 'violation', false)::INT" for s in SLOTS)} AS violated FROM verdicts_of),
      known AS (SELECT popularity AS v FROM catalog_meta WHERE popularity IS NOT NULL AND NOT isnan(popularity)),
      scale AS (SELECT round(max(v), 9) AS highest, round(list_sort(list(v))[count(*)::BIGINT // 2 + 1], 9) AS median FROM known),
      norms AS (SELECT parent_asin, CASE WHEN NOT isnan(popularity) THEN popularity END AS p FROM catalog_meta),
      scored AS (SELECT request_id, parent_asin, coalesce(fusion_score, 0) AS fusion_score, matched, violated, round(coalesce(fusion_score, 0) + CASE WHEN asked > 0 THEN (0.4::DOUBLE * matched - 0.2::DOUBLE * violated) / asked ELSE 0.0 END
        + 0.008::DOUBLE * least(1.0, greatest(0.0, coalesce(p, median, 0.5) / coalesce(highest, 13.0))) / (1 + asked), 9) AS score
        FROM counted LEFT JOIN pool USING (request_id, parent_asin) LEFT JOIN norms USING (parent_asin), scale)
      SELECT request_id, parent_asin, score, matched, violated, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, fusion_score DESC, parent_asin)::INT AS rank FROM scored""",
    "price_buckets": PRICE_SQL,
    "pool_shape": "SELECT request_id, count(*) AS n_rows, count(DISTINCT parent_asin) AS products, count(*) FILTER (coalesce(cardinality(route_scores), 0) = 0) AS without_routes, round(avg(coalesce(cardinality(route_scores), 0)), 6) AS mean_routes FROM candidates GROUP BY request_id",
    "route_presence": "WITH found AS (SELECT DISTINCT request_id, parent_asin, unnest(map_keys(route_scores)) AS route FROM candidates), alone AS (SELECT min(route) AS route FROM found GROUP BY request_id, parent_asin HAVING count(*) = 1) SELECT route, count(*) AS pairs, coalesce(any_value(n), 0) AS n_only FROM found LEFT JOIN (SELECT route, count(*) AS n FROM alone GROUP BY route) USING (route) GROUP BY route",
}
