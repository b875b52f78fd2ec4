"""Queries of the detectors and the line operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.detectors.api import API
from codesift.detectors.auth import AUTH
from codesift.detectors.crypto import CRYPTO
from codesift.detectors.file_ops import FILE_OPS
from codesift.detectors.injection import INJECTION
from codesift.detectors.secrets import SECRETS
from codesift.detectors.xss import XSS
from codesift.operators.match import detect
from codesift.queries.sql import detect_sql
from codesift.sources.corpus import files

FAMILIES = {"injection": INJECTION, "xss": XSS, "auth": AUTH, "crypto": CRYPTO, "file_ops": FILE_OPS, "api": API, "secrets": SECRETS}
ALL = tuple(p for f in FAMILIES.values() for p in f)

QUERIES, ORACLE_SQL = {}, {}


def _register(name: str, patterns) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect(files(spark, sf_dir), patterns)
        return found.select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity", "message", "hit")

    QUERIES[f"detect_{name}"] = query
    ORACLE_SQL[f"detect_{name}"] = f"WITH {detect_sql(patterns)} SELECT path, line_no::BIGINT AS line_no, col::BIGINT AS col, rule_id, severity, message, hit FROM found"


for _name, _patterns in FAMILIES.items():
    _register(_name, _patterns)
