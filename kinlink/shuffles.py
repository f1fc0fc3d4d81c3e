"""Shuffle files of a write, deleted when it is done.

Spark keeps them until the driver's collector finds that nobody can read them any more, so tables that are
written one after another would hold the disk of all their shuffles together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    """Write ``df``; its shuffles serve this write only."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
