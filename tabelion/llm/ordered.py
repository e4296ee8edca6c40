"""Places and running sums inside keys, over tables of which no task need hold a whole key.

Rows are dealt by ranges of (key, order), so a key that holds a third of all rows stretches over many tasks. Each task counts
within its own range; what a key brings along from the tasks before is one row a task, added up on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabelion.llm.common import Stages

_PART, _ROW, _FIRST = "__part", "__row", "__first"


def _segments(keys: pa.Array) -> np.ndarray:
    """Where, in a sorted array, another key begins; nulls are a key."""
    codes = keys.dictionary_encode(null_encoding="encode")
    codes = codes.indices if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks().indices
    return np.flatnonzero(np.diff(codes.to_numpy(zero_copy_only=False), prepend=-1))


def numbered(stages: Stages, df: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = (), at: str = "at", label: str = "ordered", via: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """df with the place of each row in its key (from 0, nulls first) and, for each long column s of sums, s as its running sum with this row
    and before_s without it, both modulo 2**64.

    via, a function and the schema of what it gives, works on the sorted batches of each task before they are counted; it keeps the rows' order and the key.
    Rows that are equal in key and order may come in any order, so order should tell all rows apart that differ.
    """
    spark, sums = df.sparkSession, list(sums)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # a row number settles ties, so that equal rows are shared out too
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, key, *order, "__tie").sortWithinPartitions(key, *order, "__tie").drop("__tie")
    prepare, form = via or (None, dealt.schema)
    form = T._parse_datatype_string(form) if isinstance(form, str) else form
    names = form.names
    places = [names.index(s) for s in sums]
    told = [*names, at, *(f"before_{s}" for s in sums)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, first, last, carry = TaskContext.get().partitionId(), 0, True, None, np.zeros(1 + len(sums), np.uint64)
        for b in prepare(batches) if prepare else batches:
            if not b.num_rows:
                continue
            keys = b.column(names.index(key))
            begins = _segments(keys)
            now = keys[0].as_py()
            if row and now != last:
                first, carry = False, np.zeros_like(carry)
            sizes = np.diff(np.append(begins, b.num_rows))
            ones = np.ones(b.num_rows, np.uint64)
            columns = [ones, *(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in places)]
            out = []
            for j, x in enumerate(columns):
                total = np.cumsum(x, dtype=np.uint64)
                before = np.repeat(total[begins] - x[begins], sizes)
                total = total - before
                total[: sizes[0]] += carry[j]
                out.append(total)
            is_first = np.zeros(b.num_rows, bool)
            is_first[: sizes[0]] = first
            last, first = keys[-1].as_py(), first and len(begins) == 1
            carry = np.array([x[-1] for x in out], np.uint64)
            fresh = {i: pa.array(x.view(np.int64)) for i, x in zip(places, out[1:], strict=True)}
            earlier = [pa.array((x - own).view(np.int64)) for x, own in zip(out[1:], columns[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(fresh.get(i, c) for i, c in enumerate(b.columns)), pa.array(out[0].view(np.int64) - 1), *earlier, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(row + np.arange(b.num_rows)), pa.array(is_first)],
                names=[*told, _PART, _ROW, _FIRST],
            )
            row += b.num_rows

    schema = T.StructType([*form.fields, *(T.StructField(c, T.LongType()) for c in told[len(names) :]), T.StructField(_PART, T.IntegerType()), T.StructField(_ROW, T.LongType()), T.StructField(_FIRST, T.BooleanType())])
    table = stages.keep(dealt.mapInArrow(count, schema), label)
    edge = lambda c: F.max_by(c, _ROW)
    edges = table.groupBy(_PART).agg(F.min_by(key, _ROW).alias("a"), edge(key).alias("b"), edge(at).alias("n"), *(edge(s).alias(f"s{i}") for i, s in enumerate(sums))).orderBy(_PART).collect()
    offsets, last, carry, known = {}, None, [0] * (1 + len(sums)), False
    for e in edges:
        here = carry if known and e["a"] == last else [0] * len(carry)
        if any(here):
            offsets[e[_PART]] = here
        own = [e["n"] + 1, *(e[f"s{i}"] for i in range(len(sums)))]
        carry = [(x + y) % 2**64 for x, y in zip(own, here, strict=True)] if e["a"] == e["b"] else own
        last, known = e["b"], True
    if not offsets:
        return table.drop(_PART, _ROW, _FIRST)
    every, offset = [len(names), *places, *range(len(names) + 1, len(told))], [*range(1 + len(sums)), *range(1, 1 + len(sums))]

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[: len(told)])
            parts, firsts = b.column(len(told)).to_numpy(), b.column(len(told) + 2).to_numpy(zero_copy_only=False)
            for p in np.unique(parts[firsts]).tolist():
                if p in offsets:
                    where = (parts == p) & firsts
                    for i, k in zip(every, offset, strict=True):
                        x = columns[i].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy()
                        x[where] += np.uint64(offsets[p][k] % 2**64)
                        columns[i] = pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(columns, names=told)

    return table.mapInArrow(shift, T.StructType(schema.fields[: len(told)]))
