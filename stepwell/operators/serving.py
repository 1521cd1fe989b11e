"""Serving snapshots: the current view and its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import MAX_SNAPSHOT_NAME, SLA_STATES, STAGES, VERSION, WORKSPACE

KEY = ["workspace_id", "event_date", "funnel_definition_version", "stage_name"]
COLUMNS = [*KEY, "unique_users", "snapshot_version", "canonical_completed_at", "data_sla_status"]


def snapshot(gold: DataFrame, version: str, completed_at: str, status: str = "healthy") -> DataFrame:
    return gold.withColumns({"snapshot_version": F.lit(version), "canonical_completed_at": F.lit(completed_at).cast("timestamp_ntz"), "data_sla_status": F.lit(status)}).select(COLUMNS)


def current(rows: DataFrame, by: str = "snapshot_version") -> DataFrame:
    """Each key's values in its latest snapshot, by version in text order, or by canonical_completed_at."""
    values = F.max_by(F.struct("unique_users", "snapshot_version", "canonical_completed_at", "data_sla_status"), F.struct(by, "canonical_completed_at"))
    return rows.groupBy(*KEY).agg(values.alias("v")).select(*KEY, "v.*")


def contract_violations(rows: DataFrame) -> DataFrame:
    """Adds `violation`: the first rule a serving row breaks, null if none. Extra columns break the contract for all."""
    if extra := sorted(set(rows.columns) - set(COLUMNS)):
        return rows.withColumn("violation", F.lit(f"additional_property:{extra[0]}"))
    missing = F.lit(None).cast("string")
    for c in reversed(COLUMNS[:-1]):
        missing = F.when(F.col(c).isNull(), f"missing:{c}").otherwise(missing)
    rule = (
        F.when(~F.col("workspace_id").rlike(WORKSPACE), "workspace_id")
        .when(F.col("funnel_definition_version") != VERSION, "funnel_definition_version")
        .when(~F.col("stage_name").isin(STAGES), "stage_name")
        .when(F.col("unique_users") < 0, "unique_users")
        .when(~F.length("snapshot_version").between(1, MAX_SNAPSHOT_NAME), "snapshot_version")
        .when(~F.col("data_sla_status").isin(SLA_STATES), "data_sla_status")
    )
    return rows.withColumn("violation", F.coalesce(missing, rule))
