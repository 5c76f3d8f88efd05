"""Incremental ingest: what is new at the source, in micro-batches, upserted by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.tables import VersionedTable, shared_dir


def stream_ingest(spark: SparkSession, path: str, key: str, root: str | None = None) -> DataFrame:
    """The table after all files at ``path`` that were not ingested yet have gone in, by ``key``.

    ``root`` holds the stream's progress and the table's versions, one for each micro-batch under the batch's own
    number. A later call goes on from both; a batch that runs again after a failure finds its version and changes
    nothing. A call with nothing new returns the table as it is. Without ``root`` a new one is made.
    """
    root = root or f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    table = VersionedTable(spark, f"{root}/table", key)
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        source = source.parquet(path)
    else:
        source = source.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    run = source.writeStream.foreachBatch(lambda rows, n: table.upsert(rows, n)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    done = table.read()
    table.keep(newest=2)
    return done if done is not None else spark.createDataFrame([], schema)
