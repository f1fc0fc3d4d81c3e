import glob

from pyspark.sql import functions as F

from kinlink.llm import windows
from kinlink.llm.common import materialize
from kinlink.operators.tables import write_table


def test_shuffles_of_a_written_table_go_with_the_write(spark):
    def held():
        places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in places for f in glob.glob(f"{d}/*/shuffle_*.data")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for write in (lambda df: write_table(df, "test"), lambda df: materialize(df, "test")):
        before = held()
        made = write(spark.range(20_000).withColumn("k", F.col("id") % 100).repartition(3, "k"))
        assert held() <= before
        assert made.count() == 20_000 and spark.conf.get(setting, None) in (None, "false")


def test_squeezed_bytes_come_back():
    for b in (b"", b"x", b"passage " * 9_000):
        assert windows._expand(windows._squeeze(b)) == b
    assert len(windows._squeeze(b"passage " * 9_000)) < 500
