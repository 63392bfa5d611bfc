"""The library of known cases and the parts of a case's path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sites of shallow and of deep convection, and for each model and month the sites that are missing.
SHALLOW = [*range(4, 16), *range(17, 24)]
DEEP = [30, 31, 32, 33, 66, 67, 68, 69, 70, 82, 92, 94, 96, 99, 100]
MISSING = {
    "HadGEM2-A": {10: [], 7: [], 4: [15, 17, 18], 1: [15, 17, 18, 19, 20]},
    "CNRM-CM5": {10: [15, 22, 23], 7: [13, 14, 15, 18], 4: [11, 12, 13, 14, 15, 17, 18, 21, 22, 23], 1: [14, 15, 17, 18, 19, 20, 21, 22, 23]},
    "CNRM-CM6-1": {10: [22, 23], 7: [12, 13, 14, 15, 17], 4: [13, 14, 15], 1: [14, 15, 21, 22, 23]},
}
MISSING_DEEP = {10: [94, 100], 7: [], 4: [32, 92, 94], 1: []}
DEEP_MODEL = "HadGEM2-A"
EXPERIMENTS = ["amip", "amip4K"]
FIRST_DEEP = 30


def case_library(spark: SparkSession, deep: bool = True) -> DataFrame:
    """(forcing_model, month, cfSite_number, site_type, experiment) of every case."""
    rows = [(model, month, gone, MISSING_DEEP[month] if deep and model == DEEP_MODEL else DEEP) for model, months in MISSING.items() for month, gone in months.items()]
    given = spark.createDataFrame(rows, "forcing_model string, month long, gone array<long>, gone_deep array<long>")
    sites = F.concat(F.array_except(F.array(*map(F.lit, SHALLOW)).cast("array<long>"), "gone"), F.array_except(F.array(*map(F.lit, DEEP)).cast("array<long>"), "gone_deep"))
    one = given.select("forcing_model", "month", F.explode(sites).alias("cfSite_number"))
    kind = F.when(F.col("cfSite_number") >= FIRST_DEEP, "deep").otherwise("shallow")
    return one.select("forcing_model", "month", "cfSite_number", kind.alias("site_type"), F.explode(F.array(*map(F.lit, EXPERIMENTS))).alias("experiment"))


def site_type(site: int) -> str:
    if site in SHALLOW:
        return "shallow"
    if site in DEEP:
        return "deep"
    raise ValueError(f"site {site} is not known")


def calibration_cases(spark: SparkSession, models: list[str] | None = None, most: int | None = 120) -> DataFrame:
    """Cases of the amip experiment, by model, month and site; `most` of them, all if None."""
    for m in models or []:
        if m not in MISSING:
            raise ValueError(f"model {m} is not known")
    cases = case_library(spark).where("experiment = 'amip'")
    cases = cases.where(F.col("forcing_model").isin(models)) if models else cases
    return cases if most is None else cases.orderBy("forcing_model", "month", "cfSite_number").limit(most)


def parse_case_path(path: Column | str) -> list[Column]:
    """Site, model, month and experiment of names like Output.cfsite10_<model>_<experiment>_2004-2008.01.4x."""
    parts = F.split(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1), "[._]")
    return [
        F.regexp_replace(parts[1], "[^0-9]", "").try_cast("long").alias("cfSite_number"), parts[2].alias("forcing_model"), parts[5].try_cast("long").alias("month"), parts[3].alias("experiment"),
    ]


def case_folder(root: str, site: int, model: str = DEEP_MODEL, month: int = 7, experiment: str = "amip") -> str:
    return f"{root}/{month:02d}/{model}/{experiment}/Output.cfsite{site}_{model}_{experiment}_2004-2008.{month:02d}.4x"


def valid_cases(cases: DataFrame) -> DataFrame:
    """The rows (cfSite_number, forcing_model, month, experiment and others) with a column `problem`: null, or the first part that the library does not know."""
    known = case_library(cases.sparkSession).select("forcing_model", "month", "cfSite_number", "experiment").distinct()
    parts = ["forcing_model", "month", "cfSite_number", "experiment"]
    out = cases
    for n, part in enumerate(parts):
        have = known.select(*parts[: n + 1]).distinct().withColumn(f"_has_{part}", F.lit(True))
        out = out.join(F.broadcast(have), parts[: n + 1], "left")  # the library's cases at most
    problem = F.coalesce(*(F.when(F.col(f"_has_{p}").isNull(), F.concat(F.lit(f"{p} "), F.coalesce(F.col(p).cast("string"), F.lit("?")), F.lit(" is not known"))) for p in parts))
    return out.select(*cases.columns, problem.alias("problem"))


def fields_folder(case: str, time: int = 432000) -> str:
    """The folder of a case's raw fields at a time."""
    return f"{case.rstrip('/')}/fields/{time}"


def combined_file(root: str, site: int, model: str = DEEP_MODEL, month: int = 7, experiment: str = "amip", time: int = 432000) -> str:
    """The file that holds a case's fields of all ranks at a time."""
    return f"{root}/{month:02d}/{model}/{experiment}/fields_combined/Fields.cfsite{site}_{model}_{experiment}_2004-2008.{month:02d}.{time}.nc"


def stats_file(spark: SparkSession, case: str) -> str:
    """The one statistics file below case/stats, or in the folder itself where there is no such folder; .nc files count first. None or several are an error."""
    for folder in (f"{case.rstrip('/')}/stats", case.rstrip("/")):
        for pattern in ("*.nc", "*"):
            try:
                found = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").limit(2).collect()]
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                break
            if len(found) == 1:
                return found[0]
            if found:
                raise ValueError(f"several statistics files in {folder}")
        else:
            break  # the folder is there, and empty
    raise FileNotFoundError(f"no statistics file of {case}")
