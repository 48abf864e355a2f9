"""Change feeds: a stream of files or rows, its latest state per key, and rebuilds per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tesserine.operators.incremental import with_partition
from tesserine.session import shared_folder, stored


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run ``rebuild(batch, id)`` for every micro-batch of a streaming frame.

    The checkpoint makes batches exactly once up to a restart; ``rebuild`` sees a repeated id after a failure, so it should
    overwrite what it wrote for that id. Outputs must lie outside the folder that is watched.
    """
    writer = changes.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: Partitions of a stream's state.
PARTITIONS = 32


def upsert_latest(spark: SparkSession, folder: str, keys: list[str], order: list[str], partitions: int = PARTITIONS) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest row per key under ``folder``, dealt into partitions by a hash of the key.

    A batch reads and replaces only the partitions of its keys, by dynamic partition overwrite. Taking the latest is the same
    done twice, so a batch that is repeated after a failure, wherever that was, gives the same state. A state that is gone
    when later batches come is an error.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def run(batch: DataFrame, n: int) -> None:
        exists = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder))
        if n > 0 and not exists:
            raise RuntimeError(f"the state {folder} is gone, but batch {n} builds on it")
        rest = [c for c in batch.columns if c not in keys]
        newest = lambda df: df.groupBy("part", *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select("part", *keys, *[F.col(f"v.{c}").alias(c) for c in rest])
        fresh = stored(newest(with_partition(batch, keys, partitions)), "batch")
        state = fresh
        if exists:
            touched = [r.part for r in fresh.select("part").distinct().collect()]  # at most ``partitions``
            kept = spark.read.schema(fresh.schema).parquet(folder).where(F.col("part").isin(touched))
            state = stored(newest(fresh.unionByName(kept)), "state")
        state.repartition(partitions, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)

    return run


def latest_by_key(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key of a Parquet file or folder, read as a stream until what is there has been read."""
    work = f"{shared_folder(spark).rstrip('/')}/watch-{uuid.uuid4().hex}"
    # A pattern is taken for a file as well as for a folder, where a plain path must be a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[{path[-1]}]")
    query = rebuild_on_change(stream, upsert_latest(spark, f"{work}/state", keys, order), f"{work}/checkpoint", available_now=True)
    query.awaitTermination()
    if not any(p["numInputRows"] > 0 for p in query.recentProgress):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{work}/state").select(*schema.names)
