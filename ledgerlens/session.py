"""Spark session settings the job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every session of the job needs. Month truncation is done in UTC,
# and AQE re-plans joins and partition counts from runtime sizes. A task reads
# about 16 MB of shuffled rows: it sorts them for two joins and the transactions
# and counts them by address in memory all at once, some 15 times those bytes.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own master."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(JOB_CONF)
    if shuffle_partitions:  # else the cluster's own setting holds
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_job_conf(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Pin the runtime settings on a session created elsewhere (e.g. by a driver)."""
    for key, value in JOB_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
