"""Session factory with the settings that the library's semantics rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """The active session, or a new one; either way with the library's SQL settings."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app)
        for k, v in conf.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only for a local master that has none."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tessera"
