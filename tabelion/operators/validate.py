"""Validation: stratified samples, metrics against labels, agreement of sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabelion.functions.movements import OUTCOMES, UNDETERMINED
from tabelion.functions.text import digits
from tabelion.session import staged


def smallest(df: DataFrame, label: str, size: int, order: Column, key: str, merges: int = 16) -> DataFrame:
    """(label, order, key) of the size rows with the smallest order (then key) of each label: each task keeps so many of each label, a few tasks merge them,
    so a label that most rows have is shared out. At most labels * merges * size rows meet where the last are taken."""
    rows = df.select(F.col(label).alias("label"), order.alias("order"), F.col(key).alias("key"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            every = pa.Table.from_batches([b]) if best is None else pa.concat_tables([best, pa.Table.from_batches([b])])
            every = every.sort_by([("label", "ascending"), ("order", "ascending"), ("key", "ascending")])
            codes = every.column("label").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.diff(codes, prepend=-1)) if len(codes) else np.zeros(0, int)
            place = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
            best = every.filter(pa.array(place < size))
        if best is not None:
            yield from best.to_batches()

    some = rows.mapInArrow(keep, rows.schema).repartition(merges).mapInArrow(keep, rows.schema)
    place = F.row_number().over(Window.partitionBy("label").orderBy("order", "key"))
    return some.withColumn("place", place).where(F.col("place") <= size)


def stratified(df: DataFrame, label: str, size: int, key: str, order: Column | None = None, seed: int = 42) -> DataFrame:
    """size rows: max(1, size / labels) of each label, then any others, by a hash order that runs agree on. key tells rows apart."""
    order = F.xxhash64(F.col(key), F.lit(seed)) if order is None else order
    some = staged(smallest(df, label, size, order, key), "smallest")
    quota = max(1, size // max(1, some.select("label").distinct().count()))
    # within quota first; a limit over an order needs no full sort
    chosen = some.withColumn("late", F.col("place") > quota).orderBy("late", "order", "key").limit(size)
    names = {c: f"__{c}" for c in chosen.columns}
    chosen = F.broadcast(chosen.withColumnsRenamed(names))  # at most size rows
    found = df.join(chosen, F.col(label).eqNullSafe(F.col("__label")) & F.col(key).eqNullSafe(F.col("__key")))
    return found.orderBy("__late", "__order", "__key").limit(size).drop(*names.values())


def confusion(pairs: DataFrame, actual: str = "manual", predicted: str = "automatico") -> DataFrame:
    return pairs.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def label_metrics(matrix: DataFrame, actual: str = "manual", predicted: str = "automatico") -> DataFrame:
    """Precision, recall, F1 and support of each label on either side; 0 where a denominator is 0."""
    cells = F.array(
        F.struct(F.col(actual).alias("rotulo"), F.col("n").alias("reais"), F.lit(0).cast("long").alias("previstos"), F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("certos")),
        F.struct(F.col(predicted).alias("rotulo"), F.lit(0).cast("long").alias("reais"), F.col("n").alias("previstos"), F.lit(0).cast("long").alias("certos")),
    )
    sums = matrix.select(F.inline(cells)).groupBy("rotulo").agg(F.sum("reais").alias("suporte"), F.sum("previstos").alias("previstos"), F.sum("certos").alias("certos"))
    precision, recall = (F.coalesce(F.try_divide("certos", d), F.lit(0.0)) for d in ("previstos", "suporte"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("rotulo", precision.alias("precisao"), recall.alias("cobertura"), f1.alias("f1"), "suporte").orderBy("rotulo")


def accuracy(matrix: DataFrame, actual: str = "manual", predicted: str = "automatico") -> DataFrame:
    return matrix.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("acuracia"))


def labelled(rows: DataFrame) -> DataFrame:
    """(manual, automatico) of the rows of a reviewed sample that carry a label; an unknown label is an error."""
    manual = F.lower(F.trim("resultado_manual"))
    checked = F.when(manual.isin(*OUTCOMES), manual).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), manual)))
    return rows.where(F.coalesce(F.trim("resultado_manual"), F.lit("")) != "").select(checked.alias("manual"), F.col("resultado_automatico").alias("automatico"))


def agreement(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of case and text outcomes by number, both determined; the last document of a number counts."""
    texts = documents.where((F.coalesce("numero", F.lit("")) != "") & (F.col("resultado") != UNDETERMINED)).groupBy(digits(F.col("numero")).alias("k")).agg(F.max_by("resultado", "id").alias("texto"))
    pairs = cases.where(F.col("resultado") != UNDETERMINED).select(digits(F.col("numero")).alias("k"), F.col("resultado").alias("movimento")).join(texts, "k")
    equal = F.count_if(F.col("texto") == F.col("movimento"))
    return pairs.agg(F.count("*").alias("pares"), equal.alias("iguais"), F.try_divide(equal, F.count("*")).alias("taxa"))
