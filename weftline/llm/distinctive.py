"""How distinctive a term is per record: term frequency times smoothed logarithmic inverse document frequency.

Distinct (term, record) counts give document frequencies by partial aggregation; they are joined back to the pairs. The
join is split so that no term can overload a task and nothing unbounded is broadcast: as all document frequencies add up
to the number of pairs, at most ``HOT`` terms can each hold a share of 1/HOT of the pairs. Those, the bulk of any text, meet
their pairs by broadcast, without moving them; the long tail is shuffled, where each key holds less than that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.runtime import materialize

#: Bound on the number of terms broadcast; the others each hold less than 1/HOT of all pairs.
HOT = 20_000


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept; null gives none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def blank_separated(text: str | Column) -> Column:
    """Lower-cased terms between blanks; null gives none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def tf_idf(records: DataFrame, record: str, terms: str, n_records: int, hot: int = HOT) -> DataFrame:
    """``record, term, tf, df, score`` for every term of every record; ``terms`` is an array per record, ``record`` unique.

    ``score = tf / (terms of the record) * ln((1 + n_records) / (1 + df))``: 0 for a term of all records, most for one of a
    single record; dividing by the record's length keeps long records from scoring higher throughout. Defined results: a
    record whose array is null or empty gives no rows; ties score alike; an empty table gives an empty one; columns other
    than the two named are not read.
    """
    pairs = (
        records.select(F.col(record).alias("record"), F.size(terms).alias("length"), F.explode(terms).alias("term"))
        .groupBy("record", "length", "term")
        .agg(F.count("*").alias("tf"))
    )
    # Read three times below: once for the frequencies, once for the hot and once for the other terms.
    pairs = materialize(pairs, "pairs")
    frequencies = materialize(pairs.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    n_pairs = frequencies.agg(F.sum("df")).first()[0] or 0
    is_hot = F.col("df") * hot >= n_pairs
    known = pairs.join(F.broadcast(frequencies.filter(is_hot)), "term", "left")
    common = known.filter(F.col("df").isNotNull())
    tail = known.filter(F.col("df").isNull()).drop("df").join(frequencies.filter(~is_hot), "term")
    score = F.col("tf") / F.col("length") * F.log((F.lit(1.0) + n_records) / (F.lit(1.0) + F.col("df")))
    return common.unionByName(tail).select(
        F.col("record").alias(record), "term", F.col("tf").cast("bigint"), F.col("df").cast("bigint"), F.round(score, 9).alias("score"))


def listing_terms(items: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per listing with the terms of its title and its vocabulary; repeated rows of a listing count once."""
    titles = items.groupBy("parent_asin").agg(F.max("title").alias("title"))
    vocab = meta.groupBy("parent_asin").agg(F.max("vocab").alias("vocab"))
    return titles.join(vocab, "parent_asin", "left").select(
        "parent_asin", F.concat(words("title"), blank_separated("vocab")).alias("terms"))
