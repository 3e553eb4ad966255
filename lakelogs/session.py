"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # The JVM never compiles a longer method; Spark then splits the expressions of such a stage into short ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configured(spark: SparkSession) -> SparkSession:
    """Pin what times, partitions and repeated map keys mean, and what code the JVM can compile; other performance settings stay the caller's."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
