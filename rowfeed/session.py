"""What a session needs for this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they see the driver's files; elsewhere pass it by --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
