"""Business records made from the customer table, and entities made from documents.

No table of business records is at hand, so records are spelled from customer keys: ten
keys in a row are one business in ten spellings (legal forms, domains, swapped words, padded
or shifted house numbers, missing addresses, accents, Indic script). The text is SQL that
Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "Apex,Prime,Golden,Acme,Summit,Blue Sky,Royal,United,Star,Modern,Evergreen,Pacific,Liberty,Crystal,Delta,Orion,Vertex,Noble,Harbor,Silver,Maple,Drake,Akash"
SECOND = "Motors,Foods,Textiles,Pharma,Logistics,Builders,Electronics,Jewellers,Traders,Bakery,Stationers,Optics,Furniture,Dental,Books,Marine,Garments,Tools,Seeds"
STREETS = "Main St,Oak Ave,North Street,Park Rd,Lake Dr,Hill Blvd,Station Road,Church Ln,River Rd,Market Sq,MG Road,Elm Ct,King Pl,Mill Lane,Bay Hwy,Garden Ave,Rue Voltaire"
CITIES = {
    "US": "Dallas,Reno,Austin,Boston,Denver,Tampa,Fresno",
    "India": "Hyderabad,Pune,Jaipur,Chennai,Kochi,Lucknow,Surat",
    "France": "Paris,Lyon,Nice,Lille,Nantes,Rennes,Dijon",
}
STATES = {
    "US": "Texas,Nevada,West Virginia,Massachusetts,CO,Florida,California",
    "India": "Telangana,Maharashtra,Rajasthan,Tamil Nadu,Kerala,UP,Gujarat",
    "France": "Ile-de-France,Rhone,Alpes,Nord,Loire,Bretagne,Bourgogne",
}
FORMS = "Inc.,LLC,Pvt Ltd,Corp,,SARL,Company,Ltd,& Sons,Inc"


def _pick(words: str, n: str) -> str:
    return f"split_part('{words}', ',', CAST({n} % {words.count(',') + 1} AS INT) + 1)"


def _by_country(words: dict[str, str], n: str) -> str:
    return f"CASE g % 3 WHEN 0 THEN {_pick(words['US'], n)} WHEN 1 THEN {_pick(words['India'], n)} ELSE {_pick(words['France'], n)} END"


def records_sql(customer: str = "customer") -> str:
    """SQL for (id, g, entity_id, src, name, address, country); g is the business, true links share it.

    Every seventeenth business has no partner in the corpus.
    """
    return f"""
SELECT id, g, src || '-' || lpad(CAST(id AS STRING), 9, '0') AS entity_id, src,
  CASE WHEN stem % 13 = 0 AND m IN (3, 7) THEN 'राम ' || second || ' प्रा लि'
       WHEN m = 6 THEN lower(replace(first, ' ', '')) || lower(second) || '.com'
       WHEN m = 8 THEN second || ' ' || first || ' & Sons'
       WHEN m = 4 THEN 'M/s. ' || first || ' ' || second
       WHEN stem % 11 = 0 AND m <> 0 THEN 'Société ' || first || ' ' || second || ' ' || form
       ELSE first || ' ' || second || ' ' || form END AS name,
  CASE WHEN m = 2 OR (m = 6 AND g % 2 = 0) THEN ''
       WHEN m = 5 THEN '00' || CAST(house AS STRING) || ' ' || street || ', ' || city || ', ' || state || ' ' || code
       WHEN m = 7 THEN 'Plot No ' || CAST(house AS STRING) || ', near ' || street || ', ' || city || ', ' || state || ' ' || code
       WHEN m = 9 THEN CAST(house + 4 AS STRING) || ' ' || street || ', ' || city || ', ' || state || ' ' || code
       ELSE CAST(house AS STRING) || ' ' || street || ', ' || city || ', ' || state || ' ' || code END AS address,
  CASE g % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
FROM (
  SELECT id, g, m, stem, CASE WHEN m < 3 THEN 'S1' WHEN m < 7 THEN 'S2' ELSE 'S3' END AS src,
    {_pick(FIRST, "stem")} AS first, {_pick(SECOND, "CAST(floor(stem / 23.0) AS BIGINT)")} AS second, {_pick(FORMS, "m")} AS form,
    (stem * 7) % 900 + 1 AS house, {_pick(STREETS, "stem")} AS street, {_by_country(CITIES, "stem")} AS city, {_by_country(STATES, "stem")} AS state,
    CASE g % 3 WHEN 0 THEN CAST(10000 + (stem * 37) % 89999 AS STRING) WHEN 1 THEN CAST(110001 + (stem * 53) % 700000 AS STRING)
         ELSE CAST(10000 + (stem * 91) % 85000 AS STRING) END AS code
  FROM (
    SELECT id, g, m, CASE WHEN g % 17 = 0 AND m >= 3 THEN g + 5003 ELSE g END AS stem
    FROM (SELECT c_custkey AS id, CAST(floor(c_custkey / 10.0) AS BIGINT) AS g, c_custkey % 10 AS m FROM {customer}) a
  ) b
) c"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(records_sql("{customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def truth(rows: DataFrame) -> DataFrame:
    """``(s1, cid)``: the true links of records()."""
    s1 = rows.where("src = 'S1' AND g % 17 <> 0").selectExpr("entity_id AS s1", "g")
    corpus = rows.where("src <> 'S1'").selectExpr("entity_id AS cid", "g")
    return s1.join(corpus, "g").select("s1", "cid")


TRUTH_SQL = "SELECT a.entity_id AS s1, b.entity_id AS cid FROM records a JOIN records b ON a.g = b.g WHERE a.src = 'S1' AND b.src <> 'S1' AND a.g % 17 <> 0"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: six words of name, twelve of address, the language as country."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(
        "doc_id AS id",
        "doc_id AS entity_id",
        "coalesce(lang, '') AS country",
        "CASE WHEN doc_id % 10 < 3 THEN 'S1' WHEN doc_id % 10 < 7 THEN 'S2' ELSE 'S3' END AS src",
        r"split(trim(regexp_replace(lower(coalesce(text, '')), r'(?U)[^\p{L}\p{N}_\s]+', ' ')), r'\s+') AS ws",
    ).selectExpr("id", "entity_id", "country", "src", "array_join(slice(ws, 1, 6), ' ') AS name", "array_join(slice(ws, 7, 12), ' ') AS address")
