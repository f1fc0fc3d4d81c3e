from kinlink.plans import normalize
from kinlink.sources.records import records


def test_a_small_file_is_normalised_by_all_cores(spark, sf):
    own = records(spark, sf)
    cores = spark.sparkContext.defaultParallelism
    assert own.rdd.getNumPartitions() < 2 * cores
    for made in (normalize.normalized(own), normalize.basic(own), normalize.rule_records(own), normalize.hardening(own)):
        assert made.rdd.getNumPartitions() == 2 * cores
    assert normalize.basic(own.repartition(4 * cores)).rdd.getNumPartitions() == 4 * cores
    assert normalize.basic(own).count() == own.count()
