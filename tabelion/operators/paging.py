"""Pages by keyset and the first rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(df: DataFrame, order: list[str], size: int, after: DataFrame | None = None) -> DataFrame:
    """The next size rows by order, after a cursor: one row with the columns of order, the last of the page before. A filter and a bounded sort, whatever the depth."""
    if after is not None:
        last = F.broadcast(after.select(F.struct(*order).alias("__cursor")))  # a cursor is one row
        df = df.join(last, F.struct(*order) > F.col("__cursor")).drop("__cursor")
    return df.orderBy(*order).limit(size)


def cursor(rows: DataFrame, order: list[str]) -> DataFrame:
    """Where a page ends; no rows after an empty page."""
    return rows.agg(F.max(F.struct(*order)).alias("c")).where("c IS NOT NULL").select("c.*")


def first_of_each(df: DataFrame, key: str, order: list[Column | str], most: int | Column) -> DataFrame:
    """The first rows of each group by order; most may depend on the group. Spark keeps no more than a constant number of each group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
