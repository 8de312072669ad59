"""Python workers and this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Puts the folder of this package on the path of workers that start from now on, so that a session
    works from any current folder. Clusters install the package on every machine; there it changes nothing."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
