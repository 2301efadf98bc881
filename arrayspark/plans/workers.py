"""Making this package known to Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """``spark``, whose workers look for modules beside this package too, wherever the driver was started.

    On a cluster the package must be on the nodes, as with any job; a path that isn't there is passed over.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
