"""A directory of Parquet tables as ordered plan inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from joinloom.plans.plan import TableInput
from joinloom.types import DataType


class Catalog:
    """Tables by name; ``inputs`` gives them by ordinal in the order of first use.

    primary_keys: a unique, non-null column by table, for those that have one; only these
    tables' strings can be materialised late."""

    def __init__(self, spark: SparkSession, directory: str, primary_keys: dict[str, str] | None = None):
        self.spark, self.directory = spark, directory.rstrip("/")
        self.primary_keys = primary_keys or {}
        self.inputs: list[TableInput] = []
        self._ids: dict[str, int] = {}

    def read(self, name: str) -> DataFrame:
        """The table's columns that plans can hold (other types are left out)."""
        df = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return df.select(*[f.name for f in df.schema.fields if DataType.of(f.dataType)])

    def add(self, name: str, df: DataFrame | None = None, primary_key: str | None = None) -> int:
        """Ordinal of the table; ``df`` registers a derived table under ``name``."""
        if name not in self._ids:
            pk = primary_key if df is not None else self.primary_keys.get(name)
            df = self.read(name) if df is None else df
            self._ids[name] = len(self.inputs)
            self.inputs.append(TableInput(df, df.columns.index(pk) if pk else None))
        return self._ids[name]

    def attrs(self, name: str, *columns: str) -> list[tuple[int, DataType]]:
        df = self.inputs[self.add(name)].df
        return [(df.columns.index(c), DataType.of(df.schema[c].dataType)) for c in columns]


def write_result(df: DataFrame, path: str, mode: str = "error") -> None:
    """Each task writes its own part file; no merge step."""
    df.write.mode(mode).parquet(path)
