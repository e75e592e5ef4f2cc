"""Checks that fail before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.vectors import finite


class ContractError(ValueError):
    """A broken contract between datasets, templates or parameters."""


def require(holds: bool, message: str) -> None:
    if not holds:
        raise ContractError(message)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    require(not missing, f"columns are missing: {missing}; there are {df.columns}")
    return df


def vector_report(df: DataFrame, columns: list[str], width: int) -> DataFrame:
    """One row a vector column: rows, nulls, other widths, rows with a component that is not finite."""
    checks = []
    for c in columns:
        v = F.col(c)
        checks.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.size(v) != width).alias("n_width"), F.count_if(~finite(v)).alias("n_not_finite")))
    return df.agg(F.array(*checks).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def require_slice(start: int, length: int, positions: int = 1) -> None:
    require(start >= 0, "start must not be negative")
    require(length > 0 and positions > 0, "length and positions must be positive")
