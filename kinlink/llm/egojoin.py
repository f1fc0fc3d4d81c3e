"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors of cosine c lie sqrt(2 - 2c) apart. They are turned to their principal axes
(distances stay), and the leading axes are cut into a grid whose cells have that width: two
vectors within it are in cells that differ by one at most on each axis. Each label's
vectors are sorted by cells, first axis first, and cut into blocks; two blocks are joined
only where their boxes of cells are that near, and within a pair the join is recursive:
intervals of the sequence that lie too far apart on some axis are skipped, others halved,
and small ones compared by the cosine in double precision.

Equal vectors meet as one class with a weight. Pairs of blocks give each class its number of
links and spanning links only, so a large group of near copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, materialize, read_table, scratch
from .components import connected_components

COSINE = 0.98
#: Axes of the grid, vectors of a block, and of an interval that is compared at once.
AXES, BLOCK, SMALL = 6, 1024, 128
#: Cosines of unit vectors this near the bound are computed again from the given components.
EDGE = 1e-9
#: Rounding of the rotated coordinates, in cells.
SLACK = 1e-6


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, the embedding as doubles, its digest (d1, d2), and ``able``: it can link."""
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # + 0.0 makes -0.0 the same as 0.0
    return own.withColumn("able", able).withColumn("d1", F.xxhash64("v")).withColumn("d2", F.xxhash64(F.lit(5), "v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """Orthonormal axes by falling variance of the unit vectors of one dimension; sums meet as one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0)))
                n, s, ss = n + len(u), s + u.sum(axis=0), ss + u.T @ u
        flat = np.concatenate(([n], s, ss.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "x"])

    sums = classes.where(F.size("v") == size).select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(1 + size + size * size)
    for i, x in sums.collect():
        flat[i] = x
    n = max(flat[0], 1.0)
    mean = flat[1 : 1 + size] / n
    value, vector = np.linalg.eigh(flat[1 + size :].reshape(size, size) / n - np.outer(mean, mean))
    return vector[:, np.argsort(-value, kind="stable")]


def interval_join(cells: np.ndarray, exact, self_join: bool, other: np.ndarray | None = None) -> None:
    """Call exact(a0, a1, b0, b1) for pairs of intervals of sorted cells that may hold near vectors."""
    other = cells if other is None else other
    stack = [(0, len(cells), 0, len(other))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        a, b = cells[a0:a1], other[b0:b1]
        if ((a.min(axis=0) > b.max(axis=0) + 1) | (b.min(axis=0) > a.max(axis=0) + 1)).any():
            continue
        if a1 - a0 <= SMALL and b1 - b0 <= SMALL:
            exact(a0, a1, b0, b1)
        elif self_join and (a0, a1) == (b0, b1):
            m = (a0 + a1) // 2
            stack += [(a0, m, a0, m), (m, a1, m, a1), (a0, m, m, a1)]
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            stack += [(a0, a1, b0, m), (a0, a1, m, b1)]


def _near(left: dict, right: dict, a0: int, a1: int, b0: int, b1: int, cosine: float) -> np.ndarray:
    """Which pairs have at least the cosine: by unit vectors, and within EDGE of it from the given components."""
    value = left["u"][a0:a1] @ right["u"][b0:b1].T
    near = value >= cosine
    i, j = np.nonzero(np.abs(value - cosine) < EDGE)
    if len(i):
        v, w = left["v"][a0 + i], right["v"][b0 + j]
        near[i, j] = (v * w).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((w * w).sum(axis=1))) >= cosine
    return near


def join_blocks(left: dict, right: dict | None, cosine: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Weights of linked classes on either side, and spanning links; ``right`` None: a block with itself."""
    forest = Forest()
    same = right is None
    right = left if same else right
    n = len(left["cls"])
    got = np.zeros(n, np.int64)
    gave = got if same else np.zeros(len(right["cls"]), np.int64)
    names = left["cls"] if same else np.concatenate((left["cls"], right["cls"]))
    group = np.arange(len(names))  # rows that are linked so far have one number
    shift = 0 if same else n

    def exact(a0: int, a1: int, b0: int, b1: int) -> None:
        near = _near(left, right, a0, a1, b0, b1, cosine)
        if same and (a0, a1) == (b0, b1):
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if not len(i):
            return
        np.add.at(got, a0 + i, right["m"][b0 + j])
        if not (same and (a0, a1) == (b0, b1)):
            np.add.at(gave, b0 + j, left["m"][a0 + i])
        for k in np.unique(i).tolist():
            own = group[a0 + k]
            for other in np.unique(group[shift + b0 + j[i == k]]).tolist():
                if other != own:
                    forest.union(int(names[a0 + k]), int(names[np.flatnonzero(group == other)[0]]))
                    group[group == other] = own

    interval_join(left["cells"], exact, same, right["cells"])
    return got, gave, forest


def _links_of(classes: DataFrame, size: int, cosine: float) -> DataFrame:
    """Rows ``(cls, links, to)``: weights of links found in a pair of blocks, and spanning links (to not null)."""
    axes = principal_axes(classes, size)[:, :AXES]
    width = np.sqrt(2 - 2 * cosine)
    axis_names = [f"c{k}" for k in range(axes.shape[1])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(3))
            # cells a little wider than the distance take up the rounding
            cells = np.floor(_unit(v) @ axes / (width * (1 + SLACK))).astype(np.int32) if len(v) else np.zeros((0, axes.shape[1]), np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(axes.shape[1]))], ["cls", "label", "m", "v", *axis_names])

    cells = classes.where(F.size("v") == size).select("cls", "label", "m", "v")
    cells = cells.mapInArrow(cut, "cls long, label string, m long, v array<double>, " + ", ".join(f"{c} int" for c in axis_names))

    def starts(t: pa.Table) -> list[int]:
        """Where blocks of at most BLOCK vectors of one label and leading cell begin."""
        label, lead = t["label"].to_numpy(), t["c0"].to_numpy()
        new = np.concatenate(([True], (label[1:] != label[:-1]) | (lead[1:] != lead[:-1]), [True]))
        edges = np.flatnonzero(new).tolist()
        return [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in range(a, b, BLOCK)]

    def packed(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        own = {n: t[n].chunk(0) for n in t.column_names}
        grid = [own[c].to_numpy() for c in axis_names]
        box = [pa.array([f(g)], pa.int32()) for g in grid for f in (np.min, np.max)]
        first = [own[n].slice(0, 1) for n in ("label", "c0", "cls")]
        rows = pa.StructArray.from_arrays([own[n] for n in ("cls", "m", "v", *axis_names)], ["cls", "m", "v", *axis_names])
        return pa.RecordBatch.from_arrays([*first, *box, pa.ListArray.from_arrays([0, len(t)], rows)], ["label", "c0", "block", *box_names, "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of vectors that come in grid order; a block is named by its first class."""
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) > BLOCK:
                at = starts(held)  # the last block may go on
                for x, y in zip(at[:-1], at[1:], strict=True):
                    yield packed(held.slice(x, y - x))
                held = held.slice(at[-1])
        if held is not None:
            at = [*starts(held), len(held)]
            for x, y in zip(at[:-1], at[1:], strict=True):
                yield packed(held.slice(x, y - x))

    # the grid order of all vectors, range-partitioned: a label or cell may span many partitions
    box_names = [f"{n}_{c}" for c in axis_names for n in ("lo", "hi")]
    order = ["label", *axis_names, "cls"]
    one = "struct<cls:bigint,m:bigint,v:array<double>," + ",".join(f"{c}:int" for c in axis_names) + ">"
    schema = "label string, c0 int, block long, " + ", ".join(f"{n} int" for n in box_names) + f", rows array<{one}>"
    blocks = materialize(cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema), "blocks")

    # boxes first: only pairs of blocks that may hold near vectors are sent. They meet on the label and the two leading
    # cells; a block over several second cells stands at each of them
    boxed = blocks.drop("rows")
    left = boxed.select(*(F.col(c).alias(f"a_{c}") for c in boxed.columns))
    second = ("lo_c1", "hi_c1") if len(axis_names) > 1 else ("c0", "c0")
    left = left.withColumn("_c1", F.explode(F.sequence(*(F.col(f"a_{c}") for c in second))))
    reach = F.sequence(F.col(second[0]) - 1, F.col(second[1]) + 1)
    right = boxed.withColumn("_at", F.explode(F.array(F.col("c0"), F.col("c0") - 1))).withColumn("_at1", F.explode(reach))
    near = (left.a_label == right.label) & (left.a_c0 == right._at) & (left._c1 == right._at1)
    forward = (right.c0 > left.a_c0) | (right.block >= left.a_block)
    apart = F.lit(False)
    for c in axis_names:
        apart = apart | (F.col(f"a_lo_{c}") > F.col(f"hi_{c}") + 1) | (F.col(f"lo_{c}") > F.col(f"a_hi_{c}") + 1)
    pairs = left.join(right, near & forward & ~apart).select("a_block", "block").distinct()
    # each block stays where it is, once, and its partners come to it; half of a block's pairs are its partner's
    turn = F.xxhash64("a_block").bitwiseXOR(F.xxhash64("block")).bitwiseAND(F.lit(1)) == 0
    pairs = pairs.select(F.when(turn, F.col("a_block")).otherwise(F.col("block")).alias("home"), F.when(turn, F.col("block")).otherwise(F.col("a_block")).alias("block"))
    full = blocks.select("block", "rows")
    guests = pairs.where("home <> block").join(full, "block").select("home", F.lit(1).alias("guest"), "rows")
    homes = full.select(F.col("block").alias("home"), F.lit(0).alias("guest"), "rows")
    both = homes.unionByName(guests).repartition("home").sortWithinPartitions("home", "guest")

    def block(own: pa.Array) -> dict:
        v = _matrix(own.field("v"))
        return {
            "cls": own.field("cls").to_numpy(zero_copy_only=False),
            "m": own.field("m").to_numpy(zero_copy_only=False),
            "v": v,
            "u": _unit(v),
            "cells": np.stack([own.field(c).to_numpy(zero_copy_only=False) for c in axis_names], 1),
        }

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each home comes before its guests, which pass by it one at a time."""
        home = None
        for b in batches:
            guest = b.column(1).to_pylist()
            for i in range(b.num_rows):
                one = block(b.column(2).slice(i, 1).flatten())
                if guest[i]:
                    cls = np.concatenate((home["cls"], one["cls"]))
                    got, gave, forest = join_blocks(home, one, cosine)
                    weight = np.concatenate((got, gave))
                else:
                    home = one
                    cls = one["cls"]
                    weight, _, forest = join_blocks(one, None, cosine)
                x, y = forest.links()
                cls, weight = cls[weight > 0], weight[weight > 0]
                if len(cls):
                    cls, weight = np.concatenate((cls, np.array(x, np.int64))), np.concatenate((weight, np.zeros(len(x), np.int64)))
                    to = pa.array([None] * (len(cls) - len(x)) + y, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(weight, pa.int64()), to], ["cls", "links", "to"])

    return both.mapInArrow(join, "cls long, links long, to long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``(vec_id, label, embedding)``.

    Vectors link if their labels are equal and their cosine is at least ``cosine``. Vectors that
    are null, zero, or hold null or non-finite components, and rows without a label or an id
    link with nothing; vectors of different lengths do not link. component_id is the smallest
    vec_id reachable, kept says that it is the row's own; a null vec_id is never kept.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        own = materialize(prepared(vectors), "vectors")
        classes = own.where("able").groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("m"), F.any_value("v").alias("v"))
        classes = materialize(classes, "classes")
        sizes = [r[0] for r in classes.select(F.size("v")).distinct().collect()]  # of vectors: a handful of dimensions
        found = None
        for size in sorted(sizes):
            part = _links_of(classes, size, cosine)
            found = part if found is None else found.unionByName(part)
        found = materialize(found if found is not None else spark.createDataFrame([], "cls long, links long, to long"), "egolinks")
        groups = connected_components(found.where("to is not null"), "cls", "to")
        count = found.groupBy("cls").agg(F.sum("links").alias("links"))
        named = (
            classes.select("label", "d1", "d2", "cls", "m")
            .join(count, "cls", "left")
            .join(groups, F.col("cls") == F.col("node"), "left")
            .select("label", "d1", "d2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "cls").alias("_component"))
        )
        named = materialize(named, "named")
        both = own.select("vec_id", "able", "label", "d1", "d2").join(named, ["label", "d1", "d2"], "left")
        out = both.select(
            "vec_id",
            F.when(F.col("able"), F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("able"), F.col("_component")).otherwise(F.col("vec_id")).alias("component_id"),
        ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
        return materialize(out, "near", keep=True)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by near_duplicates(): null, zero and non-finite ones link with nothing, repeated rows stay, extra columns are not read."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
