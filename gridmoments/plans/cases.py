"""From the list of cases to the table and the record of what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..options import BuildOptions
from ..schema import METADATA
from ..sources import manifest
from .builder import write_table
from .many import build_many

#: Gives the voxels of such cases (month, site, experiment and what else their table has) and a row of many.GRID for each; both name the case by month, cfSite_number, experiment and, if there are several, data_source and forcing_model.
Loader = Callable[[SparkSession, DataFrame], tuple[DataFrame, DataFrame]]
PARTS = ["data_source", "experiment", "month", "cfSite_number"]


def build_cases(spark: SparkSession, cases: DataFrame, load: Loader, table: str, record: str, options: BuildOptions = BuildOptions(), force: bool = False, spans: bool = True) -> DataFrame:
    """Builds all pending cases (month, site, experiment) as one job and returns their records (key, status, rows, timesteps).

    A case whose record says done or cloudfree is passed over, unless forced. First the record says that the others are
    being built, then what the table has of them goes, then their rows are written, at last the record says done, or
    cloudfree where a case has no rows. So a run that ends halfway is done again, and a case without clouds leaves no rows of
    an earlier build. Rows of a site count for the data source they are of.
    """
    keyed = cases.withColumn("key", F.expr(manifest.KEY))
    known = manifest.read(spark, record).where(F.col("status").isin(*manifest.FINAL)).select("key") if exists(spark, record) else spark.createDataFrame([], "key string")
    waiting = shared.written(manifest.pending(keyed, known, ["key"], force), "pending")
    form = "key string, status string, rows long, timesteps long"
    if waiting.isEmpty():
        return spark.createDataFrame([], form)
    voxels, geometries = load(spark, waiting.drop("key"))
    own = geometries.select(*(F.coalesce(F.col(c), F.lit(METADATA[c])).alias(c) if c in geometries.columns else F.lit(METADATA[c]).alias(c) for c in PARTS)).distinct()
    key = F.concat_ws("|", "cfSite_number", "month", "experiment").alias("key")
    manifest.append_rows(waiting.select("key", F.lit("building").alias("status"), F.lit(0).alias("rows"), F.lit(0).alias("timesteps")), record)
    if exists(spark, table):
        folders = spark.read.parquet(table).select(*PARTS, F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder"))
        for r in folders.join(own, PARTS, "left_semi").select("folder").distinct().toLocalIterator():  # only cases that were built before
            shared.remove(spark, r["folder"])
    built = build_many(voxels, geometries, options, spans=spans)
    write_table(built.rows, table)
    counts = row_counts(spark, table).join(own, PARTS, "left_semi") if exists(spark, table) else spark.createDataFrame([], "experiment string, month long, cfSite_number long, rows long")
    rows = counts.groupBy(key).agg(F.sum("rows").alias("rows"))
    steps = built.steps.groupBy(key).agg(F.max("timesteps").alias("timesteps"))
    done = waiting.select("key").join(rows, "key", "left").join(steps, "key", "left").fillna(0)
    done = done.select("key", F.when(F.col("rows") > 0, "done").otherwise("cloudfree").alias("status"), F.col("rows").cast("long"), F.col("timesteps").cast("long"))
    done = shared.written(done, "done")
    manifest.append_rows(done, record)
    return done


def exists(spark: SparkSession, path: str) -> bool:
    """Whether files are there that Spark can list."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def row_counts(spark: SparkSession, table: str) -> DataFrame:
    """(data_source, experiment, month, cfSite_number, rows) of a written table."""
    return spark.read.parquet(table).groupBy(*PARTS).agg(F.count(F.lit(1)).alias("rows"))
