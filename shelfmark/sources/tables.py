"""Reading the project's tables, column-pruned by what the plan selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.session import reach_workers

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "topics topic_custom_fields catalogue raw_records eval_items capacities"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the folder, a Parquet file or a folder of them."""
    reach_workers(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
