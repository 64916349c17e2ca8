"""Spark session defaults, and making this package importable by Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, adaptive plans with skew joins."""
    b = SparkSession.builder.appName("accountlens")
    b = b.master(master) if master else b
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return ready(b.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Python workers on machines that have this folder find the package. Elsewhere, ship it with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark
