"""Bucketed layouts: Bronze by event, so that it is deduplicated where it lies; Silver by journey, so that stages are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import dedupe, funnel
from .events import COLUMNS

#: Buckets a table has; on a large one, about as many as its largest day has files of 256 MB.
BUCKETS = 16
JOURNEY_BUCKET = ["workspace_id", "anonymous_id"]


def save_bucketed(df: DataFrame, name: str, path: str, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Writes a table of the session's catalog under `path`, its rows dealt to buckets by the hash of `by`, and reads it.

    Rows are dealt to as many tasks as there are buckets first, so a bucket is one file and not one of each task.
    """
    spark = df.sparkSession
    df.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(name)
    return spark.table(name)


def bucketed_gold(spark: SparkSession, bronze: DataFrame, root: str, label: str, start: str, end: str, lookback_days: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """Daily Gold from bucketed Bronze and Silver under `root`; `label` names the tables.

    Bronze lies by event, so its copies meet without a shuffle; Silver lies by journey, so the first times of stages do.
    What is left to deal are the daily counts. A workspace may be as large as it likes: no bucket is one workspace.
    """
    held = save_bucketed(bronze.select(COLUMNS), f"{label}_bronze", f"{root}/bronze", dedupe.KEY, buckets)
    silver = save_bucketed(dedupe.silver(held), f"{label}_silver", f"{root}/silver", JOURNEY_BUCKET, buckets)
    return funnel.canonical_daily(silver, start, end, lookback_days)
