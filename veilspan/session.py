"""A session set up for these plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "veilspan", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, Arrow transfer and UTC; sizes are left to the cluster unless given in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
