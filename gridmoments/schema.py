"""Column names and types of voxels and of the output table."""

from __future__ import annotations

from pyspark.sql import types as T

# Fields of a voxel, and the output table's columns in their order.
FIELDS = ["hus", "thetali", "ta", "pfull", "rhoa", "ua", "va", "wa", "clw", "cli"]
MEANS = ["qt", "theta_li", "ta", "p", "rho", "w", "q_liq", "q_ice", "q_con", "liq_fraction", "ice_fraction", "cloud_fraction", "tke"]
VARIANCES = ["var_qt", "var_ql", "var_qi", "var_w", "var_h"]
COVARIANCES = ["cov_qt_ql", "cov_qt_qi", "cov_qt_w", "cov_qt_h", "cov_ql_qi", "cov_ql_w", "cov_ql_h", "cov_qi_w", "cov_qi_h", "cov_w_h"]
SHORT = {"qt": "hus", "ql": "clw", "qi": "cli", "w": "wa", "h": "thetali"}
MEAN_OF = {"qt": "hus", "theta_li": "thetali", "ta": "ta", "p": "pfull", "rho": "rhoa", "w": "wa", "q_liq": "clw", "q_ice": "cli"}
DIAGNOSTICS = [c for c in MEANS if c != "q_con"] + VARIANCES + COVARIANCES
GEOMETRY = ["resolution_h", "domain_h", "resolution_z"]
METADATA = {"data_source": "unknown", "month": -1, "cfSite_number": -1, "forcing_model": "unknown", "experiment": "unknown"}
FLOATS = MEANS + VARIANCES + COVARIANCES + GEOMETRY
COLUMNS = FLOATS + list(METADATA)
OUTPUT = T.StructType([T.StructField(c, T.FloatType()) for c in FLOATS] + [T.StructField(c, T.LongType() if c in ("month", "cfSite_number") else T.StringType()) for c in METADATA])
#: Condensate above this is cloud.
THRESHOLD = 1e-10
