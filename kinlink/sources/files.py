"""Readers and writers of the tab-separated exchange files.

Every column is text and nulls become empty: ids and codes have leading zeros. The files
have no quoting unless ``quoted`` says so.
"""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORD = ("entity_id", "business_name", "business_address", "country")
LINKS = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD, header: bool = True, quoted: bool = False) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", '"' if quoted else "")
    return reader.csv(path).na.fill("")


def read_needed(spark: SparkSession, path: str, ids: DataFrame, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """The rows whose id is among ``ids`` (first column), by a semi-join."""
    key = ids.columns[0]
    rows = read_tsv(spark, path, columns)
    return rows.join(ids.select(F.col(key).alias(columns[0])), columns[0], "left_semi")


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(n)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """``(column, type, rows, nulls)`` of a CSV, TSV, JSON or Parquet file."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind == "parquet":
        rows = spark.read.parquet(path)
    elif kind == "json":
        rows = spark.read.json(path)
    else:
        rows = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(c).alias(c) for c in rows.columns))
    said = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), (F.col("_rows") - F.col(c)).alias("nulls")) for c, t in rows.dtypes])
    return counts.select(F.inline(said))


def read_lines(spark: SparkSession, path: str, parts: tuple[str, ...]) -> DataFrame:
    """Raw lines split at tabs; missing parts are empty."""
    cut = F.split("value", "\t")
    return spark.read.text(path).select(*(F.coalesce(F.get(cut, F.lit(i)), F.lit("")).alias(p) for i, p in enumerate(parts)))


def explode_ids(rows: DataFrame, key: str, ids: str, out: str = "cid") -> DataFrame:
    """A row for each distinct id of a comma list, with its first place ``ord``; empty lists give none."""
    own = F.array_distinct(F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != ""))
    return rows.select(F.col(key), F.posexplode(own).alias("ord", out))


def read_claims(spark: SparkSession, path: str, scale: int = 6) -> DataFrame:
    """Claim shards of a folder: ``(s1, cid, is_s3, prob)``."""
    return spark.read.schema("s1 string, cid string, is_s3 double, prob double").csv(path).withColumn("prob", F.round("prob", scale))


def write_claims(claims: DataFrame, path: str, scale: int = 6) -> None:
    claims.select("s1", "cid", "is_s3", F.round("prob", scale).alias("prob")).write.mode("overwrite").csv(path)


#: Columns and number format of each form of shard; "rules" is tab-separated.
SHARDS = {
    "v1": ("s1_index int, cid string, prob double", 4, ","),
    "v2": ("s1_index int, cid string, corpus_index int, prob double", 4, ","),
    "rules": ("s1_index int, cid string, prob double", 4, "\t"),
    "candidates": ("s1 string, cid string", 0, ","),
}


def write_shards(rows: DataFrame, path: str, form: str) -> None:
    """Rows in a form's columns, a shard for each partition."""
    columns, scale, sep = SHARDS[form]
    names = [c.split()[0] for c in columns.split(", ")]
    own = rows.select(*(F.format_string(f"%.{scale}f", F.col(c)).alias(c) if c == "prob" else F.col(c) for c in names))
    own.write.mode("overwrite").option("sep", sep).csv(path)


def read_shards(spark: SparkSession, path: str, form: str) -> DataFrame:
    """All shards of a folder in a form's columns."""
    columns, _, sep = SHARDS[form]
    return spark.read.schema(columns).option("sep", sep).csv(path)


def listed(s1: DataFrame, links: DataFrame, order: list[str], name: str = LINKS[1]) -> DataFrame:
    """One row for each row of ``s1`` (entity_id, ord), with its links as a comma list in the given order; empty if none.

    ``order`` are columns of ``links`` (s1, cid, ...); "-x" sorts x downwards. Lists stay with their
    own id, so the only thing gathered is one id's links.
    """
    keys = [(-F.col(c[1:]) if c.startswith("-") else F.col(c)) for c in order]
    own = links.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col("cid").alias("cid")))).alias("l"))
    text = F.coalesce(F.array_join(F.transform("l", lambda x: x.cid), ","), F.lit(""))
    return s1.join(own, s1.entity_id == own.s1, "left").select("ord", F.col("entity_id").alias(LINKS[0]), text.alias(name))


def write_tsv(rows: DataFrame, path: str, order: str = "ord") -> None:
    """One file in input order, with a header."""
    rows.orderBy(order).drop(order).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_parts(rows: DataFrame, path: str, by: str = "country") -> None:
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def assemble(s1: DataFrame, parts: DataFrame) -> DataFrame:
    """Part rows (source1_entity_id, matched_entity_ids) in the order of ``s1``; the first row of an id counts."""
    first = Window.partitionBy(LINKS[0]).orderBy(LINKS[1])
    own = parts.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return s1.join(own, s1.entity_id == own[LINKS[0]], "left").select("ord", F.col("entity_id").alias(LINKS[0]), F.coalesce(LINKS[1], F.lit("")).alias(LINKS[1]))


def duplicate_claims(parts: DataFrame) -> DataFrame:
    """Ids that several rows list: ``(cid, n)``."""
    return explode_ids(parts, *LINKS).groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pack(paths: list[str], out: str) -> None:
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            z.write(p, Path(p).name)


def zip_rows(rows: DataFrame, out: str, name: str, order: str = "ord") -> None:
    """The rows, tab-separated, under a header and in order, as an entry of a zip; they pass the driver one partition at a time."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(name, "w", force_zip64=True) as f:
        own = rows.orderBy(order).drop(order)
        f.write(("\t".join(own.columns) + "\n").encode())
        for r in own.toLocalIterator():
            f.write(("\t".join(map(str, r)) + "\n").encode())


def zip_entries(path: str) -> list[tuple[str, int]]:
    """Each entry's name and number of lines."""
    with zipfile.ZipFile(path) as z:
        return [(n, sum(1 for _ in z.open(n))) for n in z.namelist()]


def write_meta(meta: dict, path: str) -> None:
    Path(path).write_text(json.dumps(meta, indent=2, sort_keys=True))


def read_meta(path: str) -> dict:
    return json.loads(Path(path).read_text())


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
