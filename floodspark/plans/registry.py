"""The run registry: latest status, merges, backfill, lookups, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Latest row per run; ties on the time go to the larger sequence number.

    ``max_by`` combines before the exchange, so a run with very many reports is no
    hot partition.
    """
    rest = [c for c in events.columns if c != key]
    top = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("_v"))
    return top.select(key, "_v.*")


def merge_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local runs plus the remote runs this host does not have."""
    extra = remote.join(local.select("run_id"), "run_id", "left_anti")
    return local.withColumn("source", F.lit("local")).unionByName(
        extra.withColumn("source", F.lit("remote")), allowMissingColumns=True)


def backfill(status: DataFrame, meta: DataFrame, columns: list[str]) -> DataFrame:
    """Fill only what a finished run's status lacks from its metadata."""
    m = meta.select("run_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("has_bundle"))
    j = status.join(m, "run_id", "left")
    final = F.col("status").isin("done", "setup_only")
    for c in columns:
        have = F.nullif(F.col(c), F.lit("")) if dict(status.dtypes)[c] == "string" else F.col(c)
        j = j.withColumn(c, F.when(final, F.coalesce(have, F.col(f"_{c}"))).otherwise(F.col(c)))
    return j.drop(*[f"_{c}" for c in columns]).withColumn("has_bundle", F.coalesce("has_bundle", F.lit(False)))


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.coalesce("finished_utc", "started_utc", "submitted_utc").desc_nulls_last(), "run_id")


def delete(runs: DataFrame, doomed: DataFrame) -> DataFrame:
    """Runs left after a deletion; queued and running ones are never deleted."""
    gone = doomed.select("run_id").join(runs.where(~F.col("status").isin("queued", "running")).select("run_id"),
                                        "run_id", "left_semi")
    return runs.join(gone, "run_id", "left_anti")
