"""New queries against a standing corpus, micro-batch by micro-batch (beyond the batch presets)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import scratch, write_table
from ..plans import pipeline
from ..plans.config import BASELINE, Preset


def resolve_stream(
    spark: SparkSession, source: str, schema: str, corpus: DataFrame, out: str, checkpoint: str, preset: Preset = BASELINE, trained: PipelineModel | None = None
) -> StreamingQuery:
    """Resolve each micro-batch of new S1 records (Parquet files arriving in ``source``) against ``corpus``.

    The corpus is normalised once, and what a micro-batch writes on its way goes with it. Links go
    to ``out``, a folder for each batch, so a batch that is run again replaces itself.
    """
    standing = corpus.where("src <> 'S1'")
    known = write_table(pipeline.normal_records(standing, preset), "corpus")

    def each(batch: DataFrame, n: int) -> None:
        new = batch.where(F.col("src") == "S1")
        records = new.unionByName(standing.select(*batch.columns))
        with scratch():
            rows = write_table(pipeline.normal_records(new, preset), "normal").unionByName(known)
            pipeline.resolve(records, preset, trained, rows=rows).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
