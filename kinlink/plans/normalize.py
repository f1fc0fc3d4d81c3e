"""Records with their normalised columns; one projection for each generation of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as ad
from ..functions import fixed
from ..functions import text as tx


def spread(records: DataFrame) -> DataFrame:
    """Records in two parts a core at least: a small file comes as one part, and rules cost far more than reading."""
    parts = 2 * records.sparkSession.sparkContext.defaultParallelism
    return records if records.rdd.getNumPartitions() >= parts else records.repartition(parts, "entity_id")


def normalized(records: DataFrame, version: int = 3, strict: bool = False) -> DataFrame:
    """``records`` (entity_id, src, name, address, country) with the columns that blocking and features read.

    The normal forms are computed once and everything else is made from them.
    """
    name, addr = F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))
    rows = spread(records).select(
        F.col("entity_id").alias("doc"),
        F.col("src").alias("side"),
        "country",
        name.alias("name_raw"),
        addr.alias("addr_raw"),
        tx.universal(version, strict).col(name).alias("name_norm"),
        tx.clean_name(version, strict).col(name).alias("name_clean"),
        tx.universal(version, strict).col(addr).alias("addr_norm"),
    )
    stop = fixed.ADDRESS_STOP_V3 if version == 3 else fixed.ADDRESS_STOP_V1
    return rows.select(
        "*",
        (F.col("side") == "S3").cast("double").alias("is_s3"),
        tx.spaceless(F.col("name_norm")).alias("name_spaceless"),
        tx.word_set(F.col("name_norm")).alias("name_words"),
        tx.first_word(F.col("name_norm")).alias("first_word"),
        ad.house_number(F.col("addr_raw"), strict).alias("hn"),
        ad.postal_code(F.col("addr_raw")).alias("pc"),
        ad.address_tokens(F.col("addr_norm"), stop).alias("addr_tokens"),
        tx.numeric_tokens(F.col("addr_norm")).alias("nums"),
        tx.phonetic_keys(F.col("name_norm")).alias("phonetic_keys"),
        ad.city(F.col("addr_raw")).alias("city"),
        ad.state_part(F.col("addr_raw")).alias("state"),
        tx.legal_suffix(F.col("name_raw")).alias("legal_suffix"),
        tx.char_ngrams(F.col("name_norm"), 3, joined=True).alias("name_trigrams"),
        tx.prefix_key(F.col("name_clean"), 3).alias("first3"),
    )


def basic(records: DataFrame) -> DataFrame:
    """The baseline's normal forms."""
    return spread(records).select(
        F.col("entity_id").alias("doc"),
        F.col("src").alias("side"),
        "country",
        tx.BASIC.col("name").alias("name_norm"),
        tx.BASIC.col("address").alias("addr_norm"),
        F.coalesce("name", F.lit("")).alias("name_raw"),
        F.coalesce("address", F.lit("")).alias("addr_raw"),
    )


def hardening(records: DataFrame) -> DataFrame:
    """Name, address, house number, postal code, state and tokens, as the guards read them."""
    addr = F.trim(F.coalesce("address", F.lit("")))
    rows = spread(records).select("entity_id", "src", "country", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"), addr.alias("addr"))
    rows = rows.withColumn("hn", ad.house_number_whole(F.col("addr")))
    return rows.select(
        "*",
        ad.postal_code_by_country(F.col("addr"), F.col("country"), F.col("hn")).alias("pc"),
        ad.state(F.col("addr"), F.col("country")).alias("state"),
        ad.raw_tokens(F.col("addr")).alias("tokens"),
    )


def rule_records(records: DataFrame) -> DataFrame:
    """Names and address readings of the rule engine."""
    low = (tx.MISSING + tx.LOWER + tx.TRIM + tx.INDIC + tx.ASCII).col("address")
    rows = spread(records).select(
        F.col("entity_id").alias("doc"),
        F.col("src").alias("side"),
        "country",
        F.coalesce("name", F.lit("")).alias("name_raw"),
        F.coalesce("address", F.lit("")).alias("addr_raw"),
        tx.RULE_NAME.col("name").alias("name_clean"),
        low.alias("_low"),
    )
    return rows.withColumn("a", ad.rule_address(F.col("_low"), F.col("country"))).select("*", "a.*").drop("a", "_low")
