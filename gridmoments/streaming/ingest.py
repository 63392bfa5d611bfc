"""Incremental builds: new voxel files become table partitions, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..options import BuildOptions
from ..plans.builder import Geometry, build_table, coarsen_chunk, split_phases, write_table
from ..schema import METADATA, OUTPUT


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, geometry: Geometry, options: BuildOptions = BuildOptions(), spans: bool = True):
    """Builds all files that have come since the last call and returns the finished query.

    A micro-batch overwrites the partitions of its cases, so a batch that runs again leaves the same table. A case's files
    must come together: where an earlier batch has built a case of this one, an error is raised before anything is
    written, as its first rows would be lost. Batches and their cases are recorded beside the checkpoint.
    """

    def build(batch: DataFrame, number: int) -> None:
        rows = build_table(batch, geometry, options) if spans else coarsen_chunk(split_phases(batch) if "q_c" in batch.columns else batch, geometry, options)
        case = ["data_source", "experiment", "month", "cfSite_number"]
        named = (F.coalesce(F.col(c), F.lit(METADATA[c])) if c in batch.columns else F.lit(METADATA[c]) for c in case)
        own = batch.select(*(v.cast(OUTPUT[c].dataType).alias(c) for v, c in zip(named, case))).distinct().withColumn("batch", F.lit(number).cast("long")).persist()  # from the voxels' keys, so that the build runs once
        seen = f"{checkpoint.rstrip('/')}-cases"
        own.where("false").write.mode("append").parquet(seen)  # so that the folder is there
        before = spark.read.schema(own.schema).parquet(seen).where(F.col("batch") != number)
        if twice := own.join(before.drop("batch"), case, "left_semi").select(*case).limit(5).collect():
            raise ValueError(f"cases that an earlier batch has built: {[tuple(r) for r in twice]}")
        own.write.mode("append").parquet(seen)
        write_table(rows, target)
        own.unpersist()

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
