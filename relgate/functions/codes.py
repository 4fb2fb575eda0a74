"""Outcome codes of the gate and the join that names them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The outcome codes and their names are a contract with callers.
CODES = {
    "UNKNOWN_ERROR": 100,
    "CONFIG_ERROR": 101,
    "CODE_QUALITY_ERROR": 102,
    "OPENAI_API_ERROR": 103,
    "BUILD_FAILED": 104,
    "BUILD_CLEAN_FAILED": 105,
    "PUBLISH_ERROR": 106,
    "GIT_NO_CHANGES": 107,
    "GIT_OPERATION_FAILED": 108,
    "VERSION_UPDATE_FAILED": 109,
    "OPENAI_API_KEY_MISSING": 110,
    "MISSING_PYPROJECT": 111,
    "INVALID_PYPROJECT": 112,
    "MISSING_README": 113,
    "INVALID_README": 114,
}

PASSED = 0
CONFIG_ERROR = CODES["CONFIG_ERROR"]
QUALITY_ERROR = CODES["CODE_QUALITY_ERROR"]
CHANGE_RECORD_ERROR = CODES["OPENAI_API_ERROR"]
BUILD_FAILED = CODES["BUILD_FAILED"]
PUBLISH_ERROR = CODES["PUBLISH_ERROR"]
NO_CHANGES = CODES["GIT_NO_CHANGES"]
VERSION_ERROR = CODES["VERSION_UPDATE_FAILED"]
MISSING_RECORD = CODES["MISSING_PYPROJECT"]
INVALID_RECORD = CODES["INVALID_PYPROJECT"]
MISSING_TEXT = CODES["MISSING_README"]
INVALID_TEXT = CODES["INVALID_README"]


class GateError(Exception):
    """A gate step that could not finish, with its outcome code."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code
        self.message = message


def code_catalogue(spark: SparkSession) -> DataFrame:
    """All codes as ``(code INT, code_name STRING)``; code 0 is a pass."""
    rows = ", ".join(f"({code}, '{name}')" for name, code in {"PASSED": PASSED, **CODES}.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(code, code_name)")


def with_code_name(df: DataFrame) -> DataFrame:
    """Add ``code_name``. The catalogue is 16 fixed rows, so it is always broadcast."""
    return df.join(F.broadcast(code_catalogue(df.sparkSession)), "code", "left")
