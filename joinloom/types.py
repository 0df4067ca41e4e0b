"""The four column types of a plan and their Spark counterparts."""

from __future__ import annotations

import enum

from pyspark.sql import types as T


class PlanError(ValueError):
    """The plan is not well formed."""


class PlanTypeError(PlanError, TypeError):
    """Declared and stored types, or the types of two join keys, differ."""


class DataType(enum.Enum):
    INT32 = "int32"
    INT64 = "int64"
    FP64 = "fp64"
    VARCHAR = "varchar"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @classmethod
    def of(cls, spark_type: T.DataType) -> "DataType | None":
        """The plan type of a Spark type; None outside the model (e.g. timestamps, or
        strings of a collation that doesn't compare byte by byte)."""
        return next((k for k, v in _SPARK.items() if v == spark_type), None)


_SPARK = {
    DataType.INT32: T.IntegerType(),
    DataType.INT64: T.LongType(),
    DataType.FP64: T.DoubleType(),
    DataType.VARCHAR: T.StringType(),
}
