"""A PySpark-native engine for hybrid lexical and vector retrieval over a versioned corpus."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Let Python workers on this machine import the package; a cluster gets it by ``--py-files`` or an install."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
