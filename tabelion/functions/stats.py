"""Statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabelion.session import staged

# Fixed values.
Z = 1.96
LEAST_PUBLISHED = 10
PRIOR, LEAST_FREQUENCY = 1000.0, 5
LEAST_AMOUNT, MOST_AMOUNT = 1.0, 10_000_000.0


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Share and the bounds of Wilson's interval; null for n = 0."""
    n = F.when(n > 0, n).cast("double")
    p = hits / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return p, F.when(p.isNotNull(), F.greatest(F.lit(0.0), centre - margin)), F.when(p.isNotNull(), F.least(F.lit(1.0), centre + margin))


def quartiles(value: Column) -> Column:
    """Exact quartiles with linear interpolation, as an array; only for groups that the caller bounds or accepts to sort."""
    return F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], bins: int = 1024) -> DataFrame:
    """keys, n and the exact quantiles of a value (double), linearly interpolated as in quartiles(), whatever the size of a group; nulls don't count.

    A histogram of values combines before the shuffle. Its rows go into bins, whose edges are quantiles of the distinct values; counts of
    bins (at most `bins` + 1 a group) say which bin holds a wanted rank, and only these bins are counted through, each in
    order of values. So no buffer holds a group: a task orders a bin, about 1 / `bins` of all distinct values.
    """
    key = F.struct(F.lit(0), *keys).alias("__key")  # structs are equal with nulls in them
    counted = staged(df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")), "histogram")
    edges = sorted({e for e in counted.approxQuantile("__v", [i / bins for i in range(1, bins)], 0.5 / bins) if math.isfinite(e)}) or [0.0]
    binned = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="__v", outputCol="__bin", handleInvalid="keep").transform(counted)
    by_bin = binned.groupBy("__key", "__bin").agg(F.sum("__n").alias("__in"))
    whole, upto = Window.partitionBy("__key"), Window.partitionBy("__key").orderBy("__bin")
    placed = by_bin.withColumns({"n": F.sum("__in").over(whole), "__before": F.sum("__in").over(upto) - F.col("__in")})
    rank = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in fractions.items()}
    ends = F.array(*(F.struct(F.lit(name).alias("name"), (h - F.floor(h)).alias("part"), F.lit(high).alias("high"), (F.ceil(h) if high else F.floor(h)).alias("rank")) for name, h in rank.items() for high in (False, True)))
    wanted = placed.select("__key", "__bin", "n", "__before", "__in", F.inline(ends)).where((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__in")))
    inside = Window.partitionBy("__key", "__bin").orderBy("__v")
    ranked = binned.join(wanted.select("__key", "__bin", "__before").distinct(), ["__key", "__bin"]).withColumn("__to", F.col("__before") + F.sum("__n").over(inside))
    found = ranked.drop("__before").join(wanted.select("__key", "__bin", "n", "name", "part", "high", "rank"), ["__key", "__bin"]).where((F.col("rank") < F.col("__to")) & (F.col("rank") >= F.col("__to") - F.col("__n")))
    of = lambda name, high: F.max(F.when((F.col("name") == name) & (F.col("high") == high), F.col("__v")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    sums = found.groupBy("__key").agg(F.max("n").alias("n"), *(x for name in fractions for x in (of(name, False).alias(f"{name}__a"), of(name, True).alias(f"{name}__b"), part(name).alias(f"{name}__p"))))
    between = [(F.col(f"{n}__a") + F.when(F.col(f"{n}__p") > 0, F.col(f"{n}__p") * (F.col(f"{n}__b") - F.col(f"{n}__a"))).otherwise(0.0)).alias(n) for n in fractions]
    return sums.select(*(F.col("__key")[k].alias(k) for k in keys), "n", *between)


def log_odds(counts: DataFrame, word: str = "word", a: str = "n_a", b: str = "n_b", prior: float = PRIOR, least: int = LEAST_FREQUENCY) -> DataFrame:
    """z of the log-odds ratio with an informative Dirichlet prior, from (word, n_a, n_b); empty if a side is empty.

    The totals are one row, sent to all tasks.
    """
    totals = counts.agg(F.sum(a).cast("double").alias("all_a"), F.sum(b).cast("double").alias("all_b")).where("all_a > 0 and all_b > 0")
    rows = counts.where(F.col(a) + F.col(b) >= least).join(F.broadcast(totals))
    prior_w = prior * (F.col(a) + F.col(b)) / (F.col("all_a") + F.col("all_b"))
    with_prior = lambda n, of: (F.col(n) + prior_w) / (F.col(of) + prior - F.col(n) - prior_w)
    delta = F.log(with_prior(a, "all_a")) - F.log(with_prior(b, "all_b"))
    return rows.select(word, (delta / F.sqrt(1 / (F.col(a) + prior_w) + 1 / (F.col(b) + prior_w))).alias("z"), a, b)


def days_between(start: Column, end: Column) -> Column:
    """Whole days; null if negative."""
    days = F.datediff(end, start)
    return F.when(days >= 0, days)
