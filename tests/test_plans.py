import duckdb
import pytest

import __spark_entry__
from kinlink.plans import config, pipeline, registry
from kinlink.sources.records import records, truth
from kinlink.streaming.resolve import resolve_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = [
    "str5_universal_v3", "str18_phonetic_keys", "adr8_postal_by_country", "adr11_state", "sim6_jaro_winkler", "blk2_char_tfidf", "blk3_cosine_product", "blk9_phonetic_index",
    "blk13_index_union", "blk16_merge_neighbours", "features_sets", "m2o1_uncapped", "grd5_chain", "com1_combine_b", "agg9_macro_f05", "agg14_auc", "ml8_threshold_sweep",
    "snk1_matching_lists", "src1_tsv_scan", "val2_links", "resolve_baseline",
]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_as_sql_says(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    out = db.execute(registry.ORACLES[name])
    cols = [c[0] for c in out.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(r) for r in out.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_row_order_does_not_matter(spark, sf):
    own = records(spark, sf)
    a = sorted(tuple(r) for r in pipeline.resolve(own, config.RULES).collect())
    assert a and a == sorted(tuple(r) for r in pipeline.resolve(own.repartition(7), config.RULES).collect())


def test_resolution_finds_links(spark, sf):
    own = records(spark, sf)
    links = pipeline.resolve(own, config.SPRINT1, tau=0.3)
    found = links.join(truth(own), ["s1", "cid"]).count()
    assert found > 0.5 * links.count() > 0


def test_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    own = records(spark, sf).select("entity_id", "src", "name", "address", "country")
    new = str(tmp_path / "new")
    own.where("src = 'S1'").coalesce(1).write.parquet(new)
    query = resolve_stream(spark, new, own.schema.simpleString()[7:-1].replace(":", " "), own.where("src <> 'S1'"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = {(r.s1, r.cid) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.s1, r.cid) for r in pipeline.resolve(own, config.BASELINE).collect()}


def test_entry_and_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) > 120
