"""Evaluate the search pipeline: ``python -m weftline --catalog catalog.jsonl --dataset sessions.jsonl --output results``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from weftline.config import CODED, PINNED
from weftline.operators import catalog, shopper, simulate
from weftline.operators.blocks import Blocks
from weftline.plans.messages import coarse_columns
from weftline.plans.session import tags_of
from weftline.runtime import materialize
from weftline.sources import read_catalog, read_sessions, results, write_results


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline")
    parser.add_argument("--catalog", required=True)
    parser.add_argument("--dataset", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", choices=("coded", "pinned"), default="coded")
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    items = materialize(read_catalog(spark, chosen.catalog), "catalog")
    sessions = read_sessions(spark, chosen.dataset)
    meta = materialize(catalog.product_meta(items), "meta")
    samples = sessions.select("sample_id", "session_id", "scenario_type", F.col("ground_truth.parent_asin").alias("target"))
    scale = catalog.popularity_scale(meta).first()  # one row
    reliability = {r["slot"]: r["reliability"] for r in catalog.coverage(meta).collect()}  # six rows
    vocab = meta.select("parent_asin", F.split("vocab", " ").alias("terms")).filter(F.col("terms")[0] != "")
    verdicts, _ = simulate.simulate(
        samples, shopper.card(items), coarse_columns(items), meta, vocab, tags_of(sessions), Blocks(items), reliability, (scale["highest"], scale["median"]),
        {chosen.config: PINNED if chosen.config == "pinned" else CODED})
    verdicts = materialize(verdicts.drop("arm"), "verdicts")
    write_results(verdicts, chosen.output)
    print(results(verdicts).toJSON().first())


if __name__ == "__main__":
    main()
