"""Catalogues and labelled sessions as JSON lines, and the results of an evaluation as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.text import empty
from weftline.operators import metrics

PROFILE = "struct<purchase_frequency:string,average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>"
SESSIONS = f"sample_id string, session_id string, scenario_type string, user_profile {PROFILE}, ground_truth struct<parent_asin:string>"


def _texts(field: str) -> Column:
    """A field as an array of texts, whatever its shape: null gives none, a text or object one."""
    value = F.try_variant_get("v", f"$.{field}", "variant")
    one = F.try_variant_get("v", f"$.{field}", "string")
    return F.coalesce(F.try_variant_get("v", f"$.{field}", "array<string>"), F.when(value.isNull() | one.isNull(), empty()).otherwise(F.array(one)))


def _text(field: str) -> Column:
    return F.try_variant_get("v", f"$.{field}", "string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The products of a file of JSON lines, the last line of each id. Fields may be texts, lists, objects or absent.

    A line that is no JSON object, or has no ``parent_asin``, fails the reading: a catalogue is whole or it isn't read.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"), F.try_parse_json("value").alias("v"))
    number = lambda f: F.try_variant_get("v", f"$.{f}", "double")
    asin = F.when(_text("parent_asin").isNull(), F.raise_error(F.concat(F.lit("no product in line: "), F.left("value", F.lit(80))))).otherwise(_text("parent_asin"))
    rows = lines.select(
        "line", asin.alias("parent_asin"), _text("title").alias("title"), _texts("categories").alias("categories"), _texts("features").alias("features"),
        F.coalesce(F.try_variant_get("v", "$.details", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("details"), _text("store").alias("store"),
        _texts("description").alias("description"), number("price").alias("price"), number("average_rating").alias("average_rating"),
        F.try_variant_get("v", "$.rating_number", "bigint").alias("rating_number"))
    columns = [c for c in rows.columns if c not in ("line", "parent_asin")]
    return rows.groupBy("parent_asin").agg(F.max_by(F.struct(*columns), "line").alias("r")).select("parent_asin", "r.*")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sessions of a file of JSON lines; blank lines are skipped, broken ones fail the reading. A session without an id goes by its sample's."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", SESSIONS, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.withColumn("session_id", F.coalesce("session_id", "sample_id"))


def results(verdicts: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """One row: the metrics over all sessions, by scenario, and the tokens used. ``tokens`` has ``prompt_tokens, completion_tokens`` per turn; values that are no counts don't count."""
    whole = metrics.summary(verdicts)
    by = metrics.summary(verdicts, "scenario_type").agg(F.array_sort(F.collect_list(F.struct("scenario_type", "sessions", "hit_rate", "mrr", "mttc"))).alias("scenario_metrics"))  # a row per scenario
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).alias(c)
    usage = tokens.agg(count("prompt_tokens"), count("completion_tokens")) if tokens is not None else verdicts.sparkSession.range(1).select(F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))
    used = usage.select(F.struct("prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens")).alias("reported_token_usage"))
    return whole.crossJoin(by).crossJoin(used)  # one row each


def write_results(verdicts: DataFrame, path: str) -> None:
    """Write ``path/summary`` (one line) and ``path/sessions`` (a line for each session) as JSON."""
    results(verdicts).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    verdicts.write.mode("overwrite").json(f"{path}/sessions")
