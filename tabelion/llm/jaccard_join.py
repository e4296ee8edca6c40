"""N-gram Jaccard join: the blocked product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are classes of documents with equal n-gram sets, columns are n-grams. The product is taken block of
columns by block of columns (a block is a shuffle partition of n-grams), and overlap counts are added up along rows:

* First product, over a part of the columns. All rows order their n-grams by hash. Two sets of similarity s or more
  have at least s n n-grams in common, so their first n - s n + l n-grams hold the first l common ones of both. A row
  whose first columns meet fewer than l of other rows' (l for the smallest partner its size allows) is discarded: most
  rows are, as their texts are alike to no other.
* Second product, over all columns of the rows left: how many rows each column has, exactly. A row with fewer than s n
  columns in other rows is discarded. The columns of the rest are ordered by that count, then by hash, and the first
  n - s n + 1 are its leading columns: linked rows have one in common, and what many rows share comes last.
* Pairs. Each leading column links its rows to the one whose columns have the most rows on average, which is what the
  copies in a group were made from. Overlap counts of whole rows verify the pairs, links make components, and in
  leading columns that still hold several components all pairs of these are formed whose sizes, column places and
  parity bitmaps leave room for the needed overlap.

No step loses a link between components. Pairs within a group are not spelled out.

Null and empty texts have no n-grams: n_shingles 0, linked with nothing. Texts of fewer than k words are one n-gram.
Rows that repeat an id count as one document; if their texts differ, the set of least digest stands for it. Rows with a
null id get their counts and a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import ASCII_LOWER, Stages, arrow_limits, sent

#: Bits of a set's parity bitmap.
BITS = 512
#: The first product demands one common column for each so many n-grams of a set.
COMMON_PER = 10
#: Words a worker remembers the hashes of.
REMEMBERED = 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word -> hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of k words."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    code = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        code = mixed(code * _M + w[j : len(w) - n + 1 + j])
    return np.unique(code)


def digest(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of BITS classes of n-grams, whether the set holds an odd number of them: 64 classes a word.

    Where two sets' words differ, so do the sets; the differing bits never outnumber the differing n-grams.
    """
    odd = np.bincount((grams >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def share_of(n: int | Column, percent: int) -> int | Column:
    """percent of n, rounded up: what a set of n has in common with any linked set."""
    return -(-percent * n // 100) if isinstance(n, int) else F.ceil(n * percent / 100)


def demanded(n: int) -> int:
    """Common columns that the first product's columns of a set of n are laid out for."""
    return max(1, n // COMMON_PER)


def incidence(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, its first columns by hash and how many of them other rows must have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, heads, needed = [], [], [], []
            for text in b.column(1).to_pylist():
                own = ngrams(text, k)
                least = share_of(len(own), percent)
                n.append(len(own))
                digests.append(digest(own))
                heads.append(own[: len(own) - least + demanded(len(own))].view(np.int64))
                needed.append(demanded(least))  # a partner may be as small as that, and lays out fewer columns
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(needed, pa.int32())], names=["doc_id", "n", "digest", "heads", "needed"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n long, digest binary, heads array<long>, needed int")


def whole_sets(df: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """node, n, grams and parity bitmap of the wanted (node, digest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(i, own) for i, (text, d) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) if digest(own := ngrams(text, k)) == d]
            grams = [own.view(np.int64) for _, own in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i for i, _ in sets], pa.int64())), pa.array(list(map(len, grams)), pa.int32()), pa.array(grams, pa.list_(pa.int64())), pa.array([parity(own) for _, own in sets], pa.list_(pa.int64()))],
                names=["node", "n", "grams", "bits"],
            )

    texts = df.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(sent(wanted), "node").select("node", "text", "digest")
    return texts.mapInArrow(run, "node long, n int, grams array<long>, bits array<long>")


def met_elsewhere(rows: DataFrame, stages: Stages) -> DataFrame:
    """node, digest of the rows whose first columns meet as many of other rows' as a link needs."""
    cells = rows.select(F.col("doc_id").alias("node"), F.explode("heads").alias("gram"))
    common = cells.groupBy("gram").agg(F.count("*").alias("d")).where("d > 1").select("gram")
    met = cells.join(common, "gram", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
    return stages.keep(rows.select(F.col("doc_id").alias("node"), "digest", "needed").join(met, "node").where("met >= needed").select("node", "digest"), "met")


def leading(sets: DataFrame, percent: int) -> DataFrame:
    """gram, node, n, place, met (shared columns before it), weight (rows of the node's columns, on average) of each shared leading column."""
    cells = sets.select("node", "n", F.explode("grams").alias("gram"))
    common = cells.groupBy("gram").agg(F.count("*").cast("int").alias("d")).where("d > 1")
    rows = cells.join(common, "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("d", "gram"))).alias("shared"), F.sum("d").alias("total"))
    first = F.size("shared") - share_of(F.col("n"), percent) + 1  # the others of n - s n + 1 are in no other row
    rows = rows.where(first > 0).select("node", "n", (F.col("total") / F.col("n")).alias("weight"), (F.col("n") - F.size("shared")).alias("alone"), F.posexplode(F.slice("shared", 1, first.cast("int"))).alias("met", "c"))
    return rows.select(F.col("c.gram").alias("gram"), "node", "n", (F.col("alone") + F.col("met")).alias("place"), "met", "weight")


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def places_allow(left: dict[str, Column], right: dict[str, Column], percent: int) -> Column:
    """Whether a common column leaves room for the needed overlap, percent / (100 + percent) of both sizes.

    Before it at most `met` columns are common (those that other rows have too), from it on at most n - place.
    """
    most = F.least(left["met"], right["met"]) + F.least(left["n"] - left["place"], right["n"] - right["place"])
    return most * (100 + percent) >= percent * (left["n"] + right["n"])


def bits_allow(left: dict[str, Column], right: dict[str, Column], percent: int) -> Column:
    """Whether the bitmaps differ in no more bits than linked sets may differ in n-grams."""
    apart = sum((F.bit_count(F.get(left["bits"], F.lit(i)).bitwiseXOR(F.get(right["bits"], F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (100 - percent) * (left["n"] + right["n"])


def to_heads(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each leading column's rows with its heaviest."""
    heads = cells.groupBy("gram").agg(F.count("*").alias("d"), F.min_by(F.struct("node", "n"), F.struct(-F.col("weight"), "node")).alias("h")).where("d > 1").select("gram", "h")
    pairs = cells.join(heads, "gram").where((F.col("node") != F.col("h.node")) & sizes_allow(F.col("n"), F.col("h.n"), percent))
    return pairs.select(F.col("node").alias("a"), F.col("h.node").alias("b")).distinct()


def between_components(cells: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """Pairs (a, b) of different components in a common leading column that no bound rules out.

    Rows of a column meet by classes of sizes, so that only sizes in reach of one another do, in several tasks.
    """
    here = cells.drop("weight").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    columns = here.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    reach = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / percent)).cast("int")  # linked sizes are one class apart at most
    here = stages.keep(here.join(columns, "gram", "left_semi").join(sets.select("node", "bits"), "node").withColumn("reach", reach), "several")
    names = ("node", "n", "place", "met", "component", "bits")
    x = here.select("gram", F.explode(F.array("reach", F.col("reach") + 1)).alias("reach"), F.struct(*names).alias("x"))
    y = here.select("gram", "reach", F.struct(*names).alias("y"))
    left, right = ({c: F.col(f"{side}.{c}") for c in names} for side in "xy")
    smaller = (left["n"] < right["n"]) | ((left["n"] == right["n"]) & (left["node"] < right["node"]))
    allowed = smaller & (left["component"] != right["component"]) & sizes_allow(left["n"], right["n"], percent) & places_allow(left, right, percent) & bits_allow(left, right, percent)
    return x.join(y, ["gram", "reach"]).where(allowed).select(left["node"].alias("a"), right["node"].alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole rows overlap enough."""
    a, b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in ("a", "b"))
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.join(a, "a").join(b, "b").where(overlap * (100 + percent) >= percent * (F.size("grams_a") + F.size("grams_b"))).select("a", "b")


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """node, component (least node reachable) of all nodes in edges (a, b): least labels of neighbours, then pointer jumping, until nothing moves."""
    both = stages.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "both")
    state = stages.keep(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("other"), F.col("component").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        low = state.join(near, "node").select("node", F.least("component", "seen").alias("low"), F.col("component").alias("was"))
        low = stages.keep(low, "low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = stages.keep(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("component"), "was"), "labels")
        moved = after.where("component <> was").limit(1).count()
        stages.drop(state, low)
        state = after
        if not moved:
            return state.select("node", "component")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links of Jaccard similarity percent/100 or more)."""
    spark = df.sparkSession
    arrow_limits(spark)
    stages = Stages(spark, "jaccard")
    every = stages.keep(incidence(df, id_col, text_col, k, percent), "incidence")
    rows = every.where("n > 0 and doc_id is not null")
    ids = rows.select("doc_id", "digest")
    repeated = ids.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        ids = stages.keep(ids.groupBy("doc_id").agg(F.min("digest").alias("digest")), "ids")
        rows = rows.join(ids, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    classes = ids.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1").select("digest", "node")
    classes = sent(stages.keep(classes, "classes"))
    kept = rows.join(classes, "digest", "left").where("node is null or node = doc_id")
    sets = whole_sets(df, id_col, text_col, k, met_elsewhere(kept, stages))
    sets = stages.keep(sets.dropDuplicates(["node"]) if repeated else sets, "sets")
    cells = stages.keep(leading(sets, percent), "cells")
    edges = stages.keep(verified(stages.keep(to_heads(cells, percent), "heads"), sets, percent), "links")
    others = stages.keep(between_components(cells, sets, components(edges, stages), percent, stages), "pairs")
    edges = edges.unionByName(stages.keep(verified(others, sets, percent), "links"))
    labels = sent(components(edges, stages))
    found = every.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    if repeated:
        found = found.drop("digest").join(ids, "doc_id", "left")
    node = F.coalesce("node", "doc_id")
    found = found.join(classes, "digest", "left").select("doc_id", "n_shingles", node.alias("node"))
    return found.join(labels, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """df with the least id of each component, all columns as they are; rows without n-grams or without an id stay. Of rows that repeat an id, the one of least text stays."""
    stages = Stages(df.sparkSession, "one-of-each")
    ids = stages.keep(join(df, id_col, text_col, k, percent), "components")
    others = ids.where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    left = df.join(sent(others), df[id_col].cast("long") == F.col("__id"), "left_anti")
    if ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct("*"), F.coalesce(text_col, F.lit(""))).alias("__row")).select("__row.*")
        left = first.unionByName(left.where(F.col(id_col).isNull()))
    return left
