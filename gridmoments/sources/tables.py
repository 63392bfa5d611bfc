"""Parquet tables: listing, projection, hygiene, migration and small exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import finite
from .chunks import file_system


def list_parquet(spark: SparkSession, folder: str, most: int = 0) -> list[str]:
    """Sorted paths of the folder's Parquet files, the first `most` if that is positive; none is an error."""
    names = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path").collect())
    if not names:
        raise FileNotFoundError(f"no Parquet file in {folder}")
    return names[:most] if most > 0 else names


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def select_columns(names: list[str], columns: list[str] = (), prefixes: list[str] = (), pattern: str | None = None) -> list[str]:
    """Names that are listed, begin with a prefix or match the pattern, sorted."""
    return sorted(n for n in names if n in columns or any(map(n.startswith, prefixes)) or pattern and re.search(pattern, n))


def load_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only the asked columns are read."""
    df = spark.read.parquet(path)
    return df if columns is None else require_columns(df, columns).select(*columns)


def load_moments(spark: SparkSession, path: str, prefixes: tuple[str, ...] = ("cov_", "var_"), extra: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The moments with both resolutions and extra columns, and the moments' names."""
    df = spark.read.parquet(path)
    targets = select_columns(df.columns, prefixes=list(prefixes))
    wanted = list(dict.fromkeys(["resolution_h", "resolution_z", *targets, *extra]))
    return require_columns(df, wanted).select(*wanted), targets


def load_features(spark: SparkSession, path: str, features: list[str], targets: list[str]) -> DataFrame:
    return load_columns(spark, path, [*features, *targets]).select(*(F.col(c).cast("float").alias(c) for c in [*features, *targets]))


def file_hygiene(df: DataFrame, columns: list[str], name: str = "file") -> DataFrame:
    """(file, rows, bad, keep): files are kept if they have rows, all of them finite. Nothing is deleted."""
    good = F.lit(True)
    for c in columns:
        good = good & finite(c)
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("rows"), F.sum((~good).cast("long")).alias("bad")).withColumn("keep", (F.col("rows") > 0) & (F.col("bad") == 0))


def clean_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the files that hygiene keeps."""
    df = load_columns(spark, path, columns).withColumn("_file", F.input_file_name())
    keep = file_hygiene(df, columns, "_file").where("keep").select("_file")
    return df.join(keep, "_file", "left_semi").drop("_file")


def migrate_arrow(spark: SparkSession, source: str, target: str) -> int:
    """An Arrow file as Parquet: refuses an existing target, checks rows and column order, keeps the source; returns the rows.

    The driver reads the file's footer; its record batches are dealt to tasks, each of which reads its own.
    """
    fs, path = file_system(source)
    with fs.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        batches, form = reader.num_record_batches, spark.createDataFrame(reader.schema.empty_table()).schema

    def read(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(source)
        with fs.open_input_file(path) as f:
            reader = pa.ipc.open_file(f)
            for some in numbers:
                for k in some.column("id").to_pylist():
                    yield reader.get_batch(k)

    seen = Observation()
    rows = spark.range(0, batches, 1, max(1, min(batches, spark.sparkContext.defaultParallelism * 4))).mapInArrow(read, form).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("errorifexists").parquet(target)
    back = spark.read.parquet(target)
    if back.columns != form.names or (n := back.count()) != seen.get["n"]:
        raise ValueError(f"{target} does not hold what {source} holds")
    return n


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def preview(df: DataFrame, n: int = 10) -> tuple[str, int, list]:
    """Schema, number of rows and the first n."""
    return df.schema.simpleString(), df.count(), df.limit(n).collect()
