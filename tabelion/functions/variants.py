"""JSON columns whose fields change type: parsed once, read by type, and told by their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(json: Column) -> Column:
    """A variant of JSON text; null for null or broken text."""
    return F.try_parse_json(json)


def typed(variant: Column, **fields: tuple[str, str]) -> dict[str, Column]:
    """Columns name -> the value at a path as a type, null where it is missing or of a type that doesn't fit: name=(path, type)."""
    return {name: F.try_variant_get(variant, path, kind) for name, (path, kind) in fields.items()}


def shapes(df: DataFrame, variant: str, *keys: str) -> DataFrame:
    """keys, forma, n: which shapes a variant column has, so that a source's drift is seen and nothing is lost by it."""
    return df.groupBy(*keys, F.schema_of_variant(F.col(variant)).alias("forma")).agg(F.count("*").alias("n"))
