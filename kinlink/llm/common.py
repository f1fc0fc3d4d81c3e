"""Shared helpers of the training-data operators.

Conventions that hold for every operator of this subpackage:

* a table is read through Spark's readers only, so any store Spark knows will do;
* intermediate tables that cut lineage are written under ``spark.checkpoint.dir``;
* only the columns an operator names are read, so extra columns of any name pass by;
* a null text counts as the empty text unless an operator says otherwise;
* rows that share a doc_id are parts of one document; a null doc_id owns nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shuffles import write_parquet

#: Rows that a function takes at a time; with texts of some KB they stay at some MB.
ARROW_ROWS = 1000

_LOCAL_ROOT: list[str] = []
#: Paths of intermediate tables, for each scratch() that is open.
_SCRATCH: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into at most ARROW_ROWS rows, so that whole texts stay small in a Python worker."""
    for b in batches:
        for at in range(0, b.num_rows, ARROW_ROWS):
            yield b.slice(at, ARROW_ROWS)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. Only where executors are threads of the driver may it be a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="kinlink-"))
    return _LOCAL_ROOT[0]


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` under the shared folder and read it again; lost executors cost nothing then.

    Within scratch() the table goes when that ends; one to be kept goes with the scratch() around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/kinlink-{tag}-{uuid.uuid4().hex}"
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    write_parquet(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinlink_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_kinlink_path", None)
    if path:
        delete_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end; results that read them must be kept tables by then."""
    own: list[str] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in own:
            delete_path(spark, path)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of rows that stand together, from batches sorted by ``keys``."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if held is not None:
            cols = {n: np.concatenate([held[n], v]) for n, v in cols.items()}
        rows = len(cols[keys[0]])
        new = np.zeros(rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield {n: v[a:b] for n, v in cols.items()}
        held = {n: v[starts[-1] :] for n, v in cols.items()}
    if held is not None:
        yield held


class Forest:
    """Union-find whose links() spans each set: at most one link for each member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def links(self) -> tuple[list[int], list[int]]:
        pairs = [(x, r) for x in self.up if (r := self.find(x)) != x]
        return [a for a, _ in pairs], [b for _, b in pairs]


def pair_blocks(rows: DataFrame, key: str, member: str, cap: int) -> DataFrame:
    """Deal the members of each key to groups (key, i, j) of at most about 2 x cap rows.

    Every two members of a key meet in at least one group, so a join within groups is
    whole, and no group grows with its key: a key with more than ``cap`` members is cut
    into chunks, and each pair of chunks is a group. ``side`` is the chunk of the row.
    Keys of one member are left out.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / F.lit(cap)).cast("int")
    dealt = (
        rows.join(counts, key)
        .withColumn("_chunks", chunks)
        .withColumn("side", F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .withColumn("i", F.least("side", "_other"))
        .withColumn("j", F.greatest("side", "_other"))
    )
    return dealt.drop("_n", "_chunks", "_other")
