"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..shuffles import write_parquet

_OWN: list[str] = []
#: Tables written inside each scratch() that this thread has open.
_SCRATCH = threading.local()


def _open() -> list[list[DataFrame]]:
    return _SCRATCH.__dict__.setdefault("open", [])



def shared_folder(spark) -> str:
    """spark.checkpoint.dir. Only where executors are threads of the driver may it be a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="kinlink-er-"))
    return _OWN[0]


def write_table(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/er-{tag}-{uuid.uuid4().hex}"
    write_parquet(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    if _open():
        _open()[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those taken off the list; what reads them must have run by then."""
    own: list[DataFrame] = []
    _open().append(own)
    try:
        yield own
    finally:
        _open().pop()
        for table in own:
            discard(table)


def discard(df: DataFrame) -> None:
    path = getattr(df, "_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
