"""Session settings, applied tolerantly and reported."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from weirflow.config import Config


def settings(config: Config, cores: int) -> dict[str, str]:
    """What the engine asks of a session."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(config.advisory_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(config.broadcast_bytes),
        "spark.sql.shuffle.partitions": str(max(8, 2 * cores)),
    }


def configure(spark: SparkSession, config: Config | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """Apply what can be applied; (setting, wanted, applied, value) for each."""
    wanted = settings(config or Config(), spark.sparkContext.defaultParallelism) | (more or {})
    rows = []
    for key, value in wanted.items():
        try:
            spark.conf.set(key, value)
            applied = True
        except PySparkException:
            applied = False
        rows.append((key, value, applied, spark.conf.get(key, None)))
    return spark.createDataFrame(rows, "setting string, wanted string, applied boolean, value string")
