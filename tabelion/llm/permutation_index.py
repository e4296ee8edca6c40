"""Nearest neighbours by inner product with a permutation index.

Pivots are n_pivots vectors chosen by hash (a bounded sample); every vector is represented by its length nearest
pivots in order. The index is a written table of vectors with these lists. Queries go to the index in blocks of at most
QUERY_BYTES, so index rows never move: a task posts each Arrow batch of its rows in the inverted files of their pivots,
adds up each query's footrule similarity along the files of its own pivots, keeps the share of rows nearest by
footrule (all ties included) and ranks these by the exact inner product in double precision. A task sends the k best
of each query on; these are merged by query.

Distance to a pivot is Euclidean after vectors are divided by a norm that all but few have at most, and one coordinate is
added that gives all norm 1, which turns largest inner product into nearest neighbour; a query's added coordinate is
0. The few longer vectors are only brought to norm 1 to be posted, and are always ranked exactly.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor
do rows with a null id. Rows that repeat a vec_id are candidates each, but not for the query of that id; of queries that
repeat an id the least vector is asked. Equal scores go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabelion.llm.common import Stages, arrow_limits

#: Pivots, length of a vector's list, share of rows that is ranked exactly, share of rows that may be longer than the common norm.
N_PIVOTS, LENGTH, SHARE, LONGER = 256, 64, 0.2, 0.001
#: Rows of a block, and bytes of queries that are sent to all tasks at once.
BLOCK_ROWS, QUERY_BYTES = 16_384, 8 << 20
FOUND = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), kind)


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, also where squares overflow."""
    most = np.abs(x).max(1, initial=1e-300)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def lifted(x: np.ndarray, common: float) -> np.ndarray:
    """Rows on the unit sphere: divided by the common norm (or their own, if longer), with a coordinate for what is left."""
    y = x / np.maximum(norms(x), common)[:, None]
    return np.hstack([y, np.sqrt(np.maximum(1 - (y * y).sum(1), 0))[:, None]])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Of each row, the places of its nearest pivots in order; pivots and rows of equal norms, so the largest product is nearest."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int32)


class Index:
    """A written permutation index over (id_col, vec_col)."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = N_PIVOTS, length: int = LENGTH, block_rows: int = BLOCK_ROWS):
        self.stages = Stages(df.sparkSession, "permutation-index")
        vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        norm = F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most"))))
        sizes = vectors.withColumn("most", F.array_max(F.transform("v", F.abs))).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.percentile_approx(norm, F.lit(1 - LONGER), F.lit(10_000)).alias("common")).orderBy(F.desc("n"), "dim").limit(1).collect()
        self.dim, self.common = (sizes[0]["dim"], sizes[0]["common"]) if sizes else (0, 1.0)
        vectors = vectors.where(F.size("v") == self.dim)
        chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()
        self.pivots = lifted(np.array([r["v"] for r in chosen], float).reshape(len(chosen), self.dim), self.common)
        self.length = min(length, len(chosen))
        pivots, common, k = self.pivots, self.common, self.length

        def run(batches):
            for b in batches:
                x = matrix(pa.chunked_array([b.column(1)]))
                order = nearest_pivots(lifted(x, common), pivots, k) if len(b) else np.zeros((0, k), np.int32)
                longer = norms(x) > common * (1 + 1e-9) if len(b) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), max(k, 1)).cast(pa.list_(pa.int32())), pa.array(longer)], names=["vec_id", "v", "near", "longer"])

        arrow_limits(df.sparkSession, block_rows)
        self.block_rows = block_rows
        self.table = self.stages.keep(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, near array<int>, longer boolean"), "index")

    def search(self, queries: DataFrame, k: int = 20, share: float = SHARE, query_bytes: int = QUERY_BYTES) -> DataFrame:
        """query_id, rank, vec_id, score: the k best found for each row (query_id, q) of queries, but rows of its own id."""
        asked = queries.where(F.size("q") == self.dim).groupBy("query_id").agg(F.min("q").alias("q"))
        asked = self.stages.keep(asked, "queries")
        blocks = max(1, math.ceil(asked.count() * 8 * (self.dim + 1) / query_bytes))
        arrow_limits(queries.sparkSession, self.block_rows)
        found = None
        for block in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()  # of bounded size
            best = self._search_block(rows["query_id"].to_numpy(), matrix(rows["q"]) if rows.num_rows else np.zeros((0, self.dim)), k, share)
            found = best if found is None else found.unionByName(best)
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _search_block(self, asked: np.ndarray, q: np.ndarray, k: int, share: float) -> DataFrame:
        pivots, length = self.pivots, self.length
        # a query's distance to a pivot falls with their product, as all pivots have one norm
        near = nearest_pivots(np.hstack([q / norms(q)[:, None], np.zeros((len(q), 1))]), pivots, length) if len(q) else np.zeros((0, length), np.int32)

        def run(batches):
            ids, scores = [np.zeros(0, np.int64)] * len(asked), [np.zeros(0)] * len(asked)
            for b in batches:
                if len(b):
                    posted = Posted(b, len(pivots), length)
                    for i, own in enumerate(asked):
                        there, exact = posted.nearest(own, q[i], near[i], k, share)
                        both, ranked = np.concatenate([ids[i], there]), np.concatenate([scores[i], exact])
                        first = np.lexsort((both, -ranked))[:k]
                        ids[i], scores[i] = both[first], ranked[first]
            sizes = [len(x) for x in ids]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, sizes)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])

        return self.table.mapInArrow(run, FOUND)


class Posted:
    """A block of index rows in the inverted files of their pivots."""

    def __init__(self, rows: pa.RecordBatch, n_pivots: int, length: int):
        self.ids, self.length = rows.column(0).to_numpy(), length
        self.x, near = matrix(pa.chunked_array([rows.column(1)])), matrix(pa.chunked_array([rows.column(2)]), np.int32)
        self.longer = rows.column(3).to_numpy(zero_copy_only=False)
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows, self.places = (order // length).astype(np.int32), (order % length).astype(np.int32)
        self.begin = np.searchsorted(flat[order], np.arange(n_pivots + 1))

    def nearest(self, own: int, q: np.ndarray, near: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best among the rows nearest by footrule."""
        n = len(self.ids)
        alike = np.zeros(n, np.int32)  # footrule distance is a constant less twice this
        for rank, p in enumerate(near):
            at = slice(self.begin[p], self.begin[p + 1])
            alike[self.rows[at]] += self.length - np.maximum(self.places[at], rank)
        keep = min(n, max(k + 1, math.ceil(share * n)))  # the query may be among them
        found = np.flatnonzero((alike >= np.partition(alike, n - keep)[n - keep]) | self.longer)
        found = found[self.ids[found] != own]
        rough = self.x[found] @ q
        if len(rough) > k and np.isfinite(rough).all():
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * max(1.0, float(np.abs(rough).max()))]
        exact = np.cumsum(self.x[found] * q, axis=1)[:, -1]  # summed in the order of components, alike for equal vectors
        best = np.lexsort((self.ids[found], -exact))[:k]
        return self.ids[found][best], exact[best]


def neighbours(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each vector whose id every divides."""
    index = Index(df, id_col, vec_col)
    return index.search(index.table.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), k)
