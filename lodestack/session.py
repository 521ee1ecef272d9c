"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_spark(master: str = "local[*]", partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("lodestack")
    for key, value in (SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
