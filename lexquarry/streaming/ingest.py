"""Re-ingestion of a stream of redelivered records, as an extension: each record is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.sources import tables


def ingest(spark: SparkSession, folder: str, glob: str, target: str, key: str, order: str, cols: list[str] | None = None, files: int = 64) -> DataFrame:
    """Read the folder's new files as a stream and upsert each batch into ``target``; the table as it then is.

    The upsert keeps one row per key, the latest by ``order``, across batches and
    restarts, so the stream holds no state, nothing is too late, and a batch that is run
    again after a failure changes nothing.  Rows with a null key are left out.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)
    rows = stream.where(F.col(key).isNotNull())
    if cols:
        rows = rows.select(*cols)
    run = rows.writeStream.foreachBatch(lambda df, _: tables.put(df, target, key, order)).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return tables.load(spark, target)
