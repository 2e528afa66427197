"""Top-k text search: an inverted index, field-weighted BM25, cosine of TF-IDF vectors, prefix routes, and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.text import document_terms, search_terms
from weftline.operators.catalog import FIELDS, field_texts
from weftline.runtime import materialize

#: Saturation and length normalisation of BM25, its least idf, query length, damping and size of the fused pool.
K1, B, LEAST_IDF, QUERY_TERMS, DAMPING, POOL = 1.2, 0.75, 1e-6, 40, 60, 300


def postings(p: DataFrame) -> DataFrame:
    """``term, parent_asin, weight, category_weight, hits, length``: a term's summed field weights in a product, those of the
    categories alone, how often it stands there, and the product's tokens over all fields.

    One pass over the products; every product's tokens are counted where they are, so only distinct (term, product) pairs
    leave. The length goes with the pair, so that scoring joins nothing else.
    """
    texts = field_texts(p)
    def tagged_terms(field: str):
        w = F.lit(FIELDS[field])
        return F.transform(document_terms(texts[field]), lambda t: F.struct(t.alias("term"), w.alias("w"), (w if field == "categories" else F.lit(0.0)).alias("c")))

    tagged = p.select("parent_asin", F.concat(*[tagged_terms(f) for f in FIELDS]).alias("tokens"))
    rows = tagged.select("parent_asin", F.size("tokens").alias("length"), F.inline("tokens"))
    return rows.groupBy("parent_asin", "term").agg(F.sum("w").alias("weight"), F.sum("c").alias("category_weight"), F.count("*").alias("hits"), F.max("length").alias("length"))


class Index:
    """The inverted index, written once: its postings, the number of products, and their mean length."""

    def __init__(self, p: DataFrame):
        self.postings = materialize(postings(p), "postings")
        self.products = p.select("parent_asin").count()
        total = self.postings.agg(F.sum("hits")).first()[0] or 0
        self.mean = total / self.products if total else 1.0

    def idf(self, df: Column) -> Column:
        raw = F.log((self.products - df + 0.5) / (df + 0.5))
        return F.when(raw > 0, raw).otherwise(LEAST_IDF)

    def part(self, idf: Column, weight: Column, length: Column) -> Column:
        """What a phrase adds to a product's score."""
        return idf * weight * (K1 + 1) / (weight + K1 * (1 - B + B * length / self.mean))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """The first different search terms of each query, one row each."""
    return queries.select(key, F.explode(F.slice(F.array_distinct(search_terms(F.col(text))), 1, QUERY_TERMS)).alias("term"))


def bm25(terms: DataFrame, key: str, index: Index) -> DataFrame:
    """``key, parent_asin, score`` of every product that holds any term. ``terms`` has rows ``key, term``.

    Term statistics are joined to the query's terms first, so the large join is of (few) query rows with postings by term;
    AQE splits a term that a third of the products hold.
    """
    hits = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df.withColumn("idf", index.idf(F.col("df"))), "term")
    part = index.part(F.col("idf"), F.col("weight"), F.col("length"))
    return weighted.join(hits, "term").groupBy(key, "parent_asin").agg(F.round(F.sum(part), 6).alias("score"))


#: Kinds of a phrase: a term, any term with this beginning, and such a term among the categories.
TERM, PREFIX, CATEGORY = "term", "prefix", "category"


def category_bm25(phrases: DataFrame, key: str, index: Index) -> DataFrame:
    """``key, parent_asin, score`` of the products with a category phrase of the query, scored by all its phrases.

    ``phrases`` has rows ``key, kind, text``. A phrase that is a beginning counts as one term with the hits of all that begin
    so; a category phrase filters, and adds to the score like the others. Different phrases are looked up once.
    """
    asked = phrases.select("kind", "text").distinct()
    begun = prefix_terms(asked.filter(F.col("kind") != TERM).select(F.col("text").alias("stem")).distinct().withColumn("k", F.lit(0)), "k", index.postings.select("term").distinct())
    terms = asked.filter(F.col("kind") == TERM).withColumn("term", F.col("text")).unionByName(
        asked.filter(F.col("kind") != TERM).join(begun.select(F.col("stem").alias("text"), "term"), "text").select("kind", "text", "term"))
    weight = F.when(F.col("kind") == CATEGORY, F.col("category_weight")).otherwise(F.col("weight"))
    hits = terms.join(index.postings, "term").groupBy("kind", "text", "parent_asin").agg(F.sum(weight).alias("w"), F.max("length").alias("length")).filter("w > 0")
    hits = materialize(hits, "phrases")
    idf = hits.groupBy("kind", "text").agg(F.count("*").alias("df")).withColumn("idf", index.idf(F.col("df")))
    rows = phrases.join(idf, ["kind", "text"]).join(hits, ["kind", "text"])
    scored = rows.groupBy(key, "parent_asin").agg(
        F.round(F.sum(index.part(F.col("idf"), F.col("w"), F.col("length"))), 6).alias("score"), F.max((F.col("kind") == CATEGORY).cast("int")).alias("inside"))
    return scored.filter("inside = 1").drop("inside")


def category_phrases(queries: DataFrame, key: str) -> DataFrame:
    """``key, kind, text`` of queries with arrays ``said`` (terms, repeats kept), ``named`` (terms of attribute values) and ``stems``.

    A query without stems has no phrases. The first different terms count, message first.
    """
    held = queries.filter(F.size("stems") > 0)
    terms = held.select(key, F.lit(TERM).alias("kind"), F.explode(F.slice(F.array_distinct(F.concat("said", "named")), 1, QUERY_TERMS)).alias("text"))
    return terms.unionByName(held.select(key, F.explode(F.array(F.lit(PREFIX), F.lit(CATEGORY))).alias("kind"), "stems").select(key, "kind", F.explode(F.array_distinct("stems")).alias("text")))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Rank by falling score, then id; the best ``k`` of each query. Spark plans a group limit before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "parent_asin")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prefix_terms(stems: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """``key, stem, term``: dictionary terms that begin with a stem.

    Both sides are keyed by their first three signs, so this is an equi-join with a cheap residual condition. Stems shorter
    than that (two signs) are joined on two.
    """
    s = stems.withColumn("at", F.left("stem", F.least(F.lit(3), F.length("stem"))))
    d = dictionary.select("term", F.explode(F.array(F.left("term", F.lit(2)), F.left("term", F.lit(3)))).alias("at")).distinct()
    return s.join(d, "at").filter(F.col("term").startswith(F.col("stem"))).select(key, "stem", "term").distinct()


def fuse(routes: DataFrame, key: str, priority: list[str], limit: int = POOL) -> DataFrame:
    """Reciprocal rank fusion of rows ``key, route, parent_asin, score, rank``.

    Order: fused score, best rank, place of the route in ``priority``, id. Raw scores of the routes are kept.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in priority]), F.col("route")), F.lit(0)), F.lit(len(priority) + 1))
    fused = routes.withColumn("place", F.struct("rank", place.alias("place"))).groupBy(key, "parent_asin").agg(
        F.round(F.sum(1.0 / (DAMPING + F.col("rank"))), 9).alias("fusion_score"), F.min("place").alias("best"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "score")))).alias("route_scores"))
    order = Window.partitionBy(key).orderBy(F.desc("fusion_score"), F.col("best.rank"), F.col("best.place"), "parent_asin")
    return fused.withColumn("pool_pos", F.row_number().over(order)).filter(F.col("pool_pos") <= limit).drop("best")


def tf_idf_cosine(terms: DataFrame, key: str, index: DataFrame, n: int) -> DataFrame:
    """Cosine of query and product vectors with weights (1 + ln tf) * ln(n / (1 + df)); products without positive weights never score.

    ``index`` has rows ``term, parent_asin, weight``. Products are met by the query's terms; only theirs are normed.
    """
    df = index.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n)) / (1 + F.col("df"))))
    vectors = index.join(df.filter("idf > 0"), "term").withColumn("w", (1 + F.log("weight")) * F.col("idf"))
    norms = vectors.groupBy("parent_asin").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    query = terms.join(df.filter("idf > 0"), "term").groupBy(key, "term").agg(((1 + F.log(F.count("*"))) * F.max("idf")).alias("q"))
    query_norms = query.groupBy(key).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("query_norm"))
    dots = query.join(vectors, "term").groupBy(key, "parent_asin").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    return dots.join(norms, "parent_asin").join(query_norms, key).select(
        key, "parent_asin", F.round(F.col("dot") / F.col("norm") / F.col("query_norm"), 6).alias("score"))


#: Queries of a block, and copies of each block that data is spread over.
BLOCK, SALTS = 2048, 32


def nearest(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """``vec_id, neighbour, score, rank``: the ``k`` nearest others by cosine of every vector that ``asked`` holds for.

    The stated queries go in blocks of about ``BLOCK`` against batches of all vectors, a matrix product for each; a batch gives
    the best ``k`` of each query only. Blocks and batches meet by equal keys, salted, so that no task has all of a block.
    Defined results: vectors of no length, null ones and those with other numbers of dimensions than the query have no cosine.
    """
    import numpy as np
    import pyarrow as pa

    rows = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    queries = rows.filter(asked)
    blocks = -(-queries.count() // BLOCK) or 1
    grouped = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    copies = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def batches(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b.column(1).to_pylist()], pa.list_(pa.list_(pa.float64())))], names=["ids", "vs"])

    data = rows.mapInArrow(batches, "ids array<bigint>, vs array<array<double>>").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"))
    met = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(copies, ["block", "salt"])

    def unit(vs: list, size: int):
        m = np.array([v if len(v) == size else [np.nan] * size for v in vs], float).reshape(len(vs), size)
        with np.errstate(all="ignore"):
            return m / np.sqrt((m * m).sum(1, keepdims=True))

    def products(parts):
        for b in parts:
            found = []
            for ids, vs, asked_for in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("ids", "vs", "queries"))):
                for size in {len(q["v"]) for q in asked_for}:
                    mine = [q for q in asked_for if len(q["v"]) == size]
                    scores = np.round(unit([q["v"] for q in mine], size) @ unit(vs, size).T, 6)
                    for q, line in zip(mine, scores):
                        near = sorted((-s, i) for s, i in zip(line.tolist(), ids) if s == s and i != q["vec_id"])[:k] if len(ids) <= 4 * k else None
                        if near is None:
                            line = np.where(np.isnan(line) | (np.array(ids) == q["vec_id"]), -np.inf, line)
                            edge = np.partition(line, -k)[-k]
                            near = sorted((-line[j], ids[j]) for j in np.flatnonzero((line >= edge) & np.isfinite(line)))[:k]
                        found += [(q["vec_id"], i, -float(s)) for s, i in near]
            columns = list(zip(*found)) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["vec_id", "parent_asin", "score"])

    scored = met.select("ids", "vs", "queries").mapInArrow(products, "vec_id bigint, parent_asin bigint, score double")
    return top(scored, "vec_id", k).withColumnRenamed("parent_asin", "neighbour")
