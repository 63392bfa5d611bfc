"""The append-only record of checked cases: key, status, rows, timesteps, time, separated by tabs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "concat_ws('|', site, month, experiment)"


def case_key(site: int, month: int, experiment: str) -> str:
    return f"{site}|{month}|{experiment}"


def latest(lines: DataFrame, text: str = "value", order: str = "line") -> DataFrame:
    """(key, status, rows, timesteps, timestamp): the last record of each key. Blank lines, comments and short records do not count; bad numbers are 0."""
    parts = F.split(text, "\t")
    good = lines.where((F.trim(text) != "") & ~F.col(text).startswith("#") & (F.size(parts) >= 5))
    number = lambda k: F.coalesce(parts[k].try_cast("long"), F.lit(0))
    record = F.struct(parts[1].alias("status"), number(2).alias("rows"), number(3).alias("timesteps"), parts[4].alias("timestamp"))
    return good.groupBy(parts[0].alias("key")).agg(F.max_by(record, order).alias("r")).select("key", "r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parts count in the order of the times in their folders' names, then by path; lines in their order within one.

    Only parts of one file share a Spark partition with certainty, so the running number orders lines of one block alone.
    """
    place = F.col("_metadata.file_path")
    order = F.struct(F.regexp_extract(place, "/at=([^/]+)/", 1).alias("at"), place.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return latest(spark.read.text(path).select("value", order.alias("line")))


def append(spark: SparkSession, path: str, cases: list[tuple[int, int, str, str, int, int]]) -> None:
    """Adds (site, month, experiment, status, rows, timesteps) as a part whose name sorts behind those before."""
    append_rows(spark.createDataFrame([(case_key(*c[:3]), *c[3:]) for c in cases], "key string, status string, rows long, timesteps long"), path)


def append_rows(records: DataFrame, path: str) -> None:
    """Adds rows (key, status, rows, timesteps), one for each key, from wherever they are."""
    now = datetime.now(timezone.utc)
    records.select(F.concat_ws("\t", "key", "status", "rows", "timesteps", F.lit(now.isoformat())).alias("value")).write.mode("append").text(f"{path}/at={now:%Y%m%dT%H%M%S%f}")


#: Records of cases that need no more work; others, as of a run that ended halfway, do.
FINAL = ("done", "cloudfree")


def pending(cases: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Cases without a record."""
    return cases if force else cases.join(done.select(*keys), keys, "left_anti")


def expand_cases(spark: SparkSession, sites: list[int], months: list[int], experiments: list[str]) -> DataFrame:
    """All (month, site, experiment), by month first."""
    return spark.createDataFrame([(m, s, e) for m in months for s in sites for e in experiments], "month long, site long, experiment string")
