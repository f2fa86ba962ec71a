"""Part files merged as they arrive.

The greatest weight of a pair doesn't depend on the order of arrival or on repeats, so that the
merge of part files is a streaming aggregation with a state of one row per pair.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..runtime import checkpoint_dir


def merged_stream(parts: DataFrame) -> DataFrame:
    """The streaming form of ``graphs.merge_parts`` for a stream of ``u, v, w``; emits updated pairs."""
    return E.positive(E.merge_max(parts))


def merge_files(spark: SparkSession, schema: str, path: str, name: str, prepare=lambda df: df, files: int = 4) -> DataFrame:
    """What the stream has merged once all files in ``path`` are read, some ``files`` at a time.

    Each batch's updates are written to the shared folder; of a pair the last update, which is the
    greatest, counts. ``name`` names the run's folder.
    """
    folder = f"{checkpoint_dir(spark)}/{name}"
    # Readable as one file or as a folder of files.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    updates = merged_stream(prepare(stream))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("u", "v").agg(F.max("w").alias("w"))
