"""One ranking per request from several differently scaled scores.

Each score is replaced by its mid-rank within the request, scaled to (0, 1), so that neither scale, sign of scale nor
outliers matter. A distributed correlation matrix of the ranks gives the first principal component; its loadings take the
signs of the declared directions, and items are sorted by their projection.

Ranks and final positions are taken by slices of a request's values (``operators.prefix``), so that no request, however
large, is gathered in one task; how many slices a request has follows from its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.operators.prefix import ROWS, number_rows, slice_large, slice_offsets
from weftline.runtime import materialize, release

#: Declared direction of each score: 1 where more is better. Scores not named are taken as 1.
DIRECTIONS = {"bm25": 1, "category": 1, "attribute": 1, "dense": 1, "popularity": 1}

#: Correlation of a build's ranks with the logged pool position from which the score counts as logged upside down, at any number of rows.
UPSIDE_DOWN = 0.1


def score_names(candidates: DataFrame) -> list[str]:
    """Names of the routes that logged any score; there are a few."""
    names = candidates.select(F.explode(F.map_keys("route_scores")).alias("name")).distinct().collect()
    return sorted(r["name"] for r in names if r["name"] != "popularity")


def wide(candidates: DataFrame, meta: DataFrame, routes: list[str]) -> DataFrame:
    """One row per request and item with a column ``s0, s1, ...`` for each score, popularity last; null where absent or not finite.

    Repeated rows of an item count once; where they differ, the best logged position and the highest scores count.
    """
    def finite(c: Column) -> Column:
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    popularity = meta.groupBy("parent_asin").agg(F.max(finite(F.col("popularity"))).alias("popularity"))
    raw = candidates.select(
        "request_id", "parent_asin", "build_tag", "pool_pos",
        *[finite(F.try_element_at("route_scores", F.lit(r))).alias(f"s{i}") for i, r in enumerate(routes)])
    return (
        raw.join(popularity, "parent_asin", "left")
        .groupBy("request_id", "parent_asin")
        .agg(F.max("build_tag").alias("build_tag"), F.min("pool_pos").alias("pool_pos"),
             *[F.max(f"s{i}").alias(f"s{i}") for i in range(len(routes))], F.max("popularity").alias(f"s{len(routes)}"))
    )


def ranks(items: DataFrame, k: int, rows: int = ROWS) -> DataFrame:
    """Rank-transformed scores of all requests, written to the shared folder: ``request_id, parent_asin, build_tag, pool_pos, n, h*, r*, a*``.

    ``r`` is the mid-rank, (rows below + half the ties) / rows, absent scores tied below all others; ``a`` the share absent,
    ``h`` whether the score is there. Scores are ranked in rows of their own, by slices of a request's values: one for a
    request of at most ``rows`` candidates, and as many as its size asks for beyond that.
    """
    sizes = items.groupBy(F.col("request_id").alias("of")).agg(F.count("*").cast("int").alias("n"), *[F.count(f"s{i}").cast("int").alias(f"p{i}") for i in range(k)])
    sized = items.join(sizes, F.col("request_id").eqNullSafe(F.col("of"))).drop("of")
    sized = materialize(sized.withColumn("id", F.monotonically_increasing_id()), "items")  # ids are as written
    scores = F.filter(F.array(*[F.struct(F.lit(i).cast("byte").alias("key"), F.col(f"s{i}").alias("score")) for i in range(k)]), lambda x: x["score"].isNotNull())
    long = slice_large(sized.select("request_id", "id", "n", F.inline(scores)), "request_id", "key", "score", "n", rows)
    inside = Window.partitionBy("request_id", "key", "slice").orderBy("score")
    local = (F.rank().over(inside) - 1 + F.count("*").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2
    offsets = slice_offsets(long, "request_id", "key", "n", rows).drop("total")
    ranked = long.select("request_id", "id", "key", "slice", local.alias("local")).join(offsets, ["request_id", "key", "slice"], "left")
    below = ranked.select("id", "key", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("below"))
    # Ranks meet their item by its id: one narrow row for each score, and one for the item itself.
    whole = sized.drop(*[f"s{i}" for i in range(k)])
    facts = [c for c in whole.columns if c != "id"]
    none = lambda c: F.lit(None).cast(whole.schema[c].dataType).alias(c)
    both = below.select("id", "key", "below", *[none(c) for c in facts]).unionByName(
        whole.select("id", F.lit(None).cast("byte").alias("key"), F.lit(None).cast("double").alias("below"), *facts))
    wide_ = both.groupBy("id").agg(*[F.max(c).alias(c) for c in facts], *[F.max(F.when(F.col("key") == i, F.col("below"))).alias(f"b{i}") for i in range(k)])
    absent = lambda i: F.col("n") - F.col(f"p{i}")
    out = wide_.select(
        "request_id", "parent_asin", "build_tag", "pool_pos", "n", *[F.col(f"b{i}").isNotNull().alias(f"h{i}") for i in range(k)],
        *[(F.coalesce(absent(i) + F.col(f"b{i}"), absent(i) / 2) / F.col("n")).alias(f"r{i}") for i in range(k)], *[(absent(i) / F.col("n")).alias(f"a{i}") for i in range(k)])
    out = materialize(out, "ranks")
    release(sized)
    return out


def logged_signs(ranked: DataFrame, k: int) -> dict[str, list[int]]:
    """Per build, whether it logs each score upside down: -1 where ranks rise clearly with the logged pool position.

    One row per build comes back. A score that follows the position in the expected sense, or not clearly, keeps 1; the
    last column, popularity, isn't logged by builds.
    """
    if k == 1:
        return {}
    sums = ranked.groupBy("build_tag").agg(*[
        x for i in range(k - 1) for held in [F.col(f"h{i}")] for x in (
            F.corr(F.when(held, F.col(f"r{i}")), F.when(held, F.col("pool_pos").cast("double"))).alias(f"c{i}"),)])
    out = {}
    for row in sums.collect():
        clear = [row[f"c{i}"] is not None and row[f"c{i}"] > UPSIDE_DOWN for i in range(k - 1)]
        out[row["build_tag"]] = [*[-1 if c else 1 for c in clear], 1]
    return out


def oriented(ranked: DataFrame, k: int, signs: dict[str, list[int]], directions: list[int]) -> DataFrame:
    """Ranks ``x0..`` with 1 the best: those of scores declared or logged the other way round are mirrored among the present values."""
    columns = []
    for i in range(k):
        flipped = [tag for tag, s in signs.items() if s[i] * directions[i] < 0]
        mirrored = F.when(F.col(f"h{i}"), 1 + F.col(f"a{i}") - F.col(f"r{i}")).otherwise(F.col(f"r{i}"))
        named = [t for t in flipped if t is not None]
        at = F.col("build_tag").isin(named) if named else F.lit(False)
        if None in flipped:
            at = at | F.col("build_tag").isNull()
        columns.append(F.when(F.coalesce(at, F.lit(False)), mirrored).otherwise(F.col(f"r{i}")).alias(f"x{i}"))
    return ranked.select("request_id", "parent_asin", "n", *columns)


def first_component(x: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and loadings. One row of k (k + 3) / 2 sums comes to the driver; the matrix is k by k.

    Loadings are signed by direction: ranks already run from worst to best, so every loading counts upwards. A score
    without variance has loading 0; without any variance all loadings are 0.
    """
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = x.agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"m{i}") for i in range(k)],
                *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = row["n"]
    if not n:
        return np.full(k, 0.5), np.ones(k), np.zeros(k)
    mean = np.array([row[f"m{i}"] / n for i in range(k)])
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / n - mean[i] * mean[j]
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    live = sd > 1e-9
    loadings = np.zeros(k)
    if live.any():
        corr = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        loadings[live] = np.abs(np.linalg.eigh(corr)[1][:, -1])
    return mean, np.where(live, sd, 1.0), loadings


def fuse(candidates: DataFrame, meta: DataFrame, directions: dict[str, int] | None = None, large: int = ROWS) -> tuple[DataFrame, list[dict]]:
    """``request_id, parent_asin, score, rank`` of every candidate, and what was learned of each score.

    Defined results: a score that is null, NaN, infinite or not logged is absent and ranks below all present ones of its
    request, tied; a score absent from a whole request is a tie and says nothing; equal projections are ranked by
    ``parent_asin``; repeated rows give one; an empty table gives an empty ranking. ``large`` is the number of candidates in a slice.
    """
    directions = DIRECTIONS if directions is None else directions
    routes = score_names(candidates)
    names = [*routes, "popularity"]
    k = len(names)
    declared = [directions.get(n, 1) for n in names]
    ranked = ranks(wide(candidates, meta, routes), k, large)
    signs = logged_signs(ranked, k)
    x = oriented(ranked, k, signs, declared)
    mean, sd, loadings = first_component(x, k)
    score = sum(((F.col(f"x{i}") - float(mean[i])) * float(loadings[i] / sd[i]) for i in range(k)), F.lit(0.0))
    scored = x.select("request_id", "parent_asin", "n", F.round(score, 9).alias("score"))
    learned = [{"score": n, "direction": declared[i], "loading": float(loadings[i] * declared[i]),
                "upside_down": sorted(str(t) for t, s in signs.items() if s[i] < 0)} for i, n in enumerate(names)]
    return number_rows(scored, "request_id", "score", ["parent_asin"], "rank", large, size="n").drop("n"), learned
