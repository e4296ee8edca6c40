"""Merkle manifest of a dataset by superblock reduction.

A leaf is H (SHA-256 as lower-case hexadecimal digits) of a row's fields, each as '-' if null, else as its UTF-8 byte count, ':' and the
value. Leaves of a source ascend by identifier; while several nodes remain, every FANOUT consecutive ones become the H of their digits
(a last run may be shorter, even one node). The node that remains is the source's subroot; subroots, ordered by source (null first,
bytewise), are reduced in the same way to the root. A leaf's proof is its siblings, level by level up to the root.

Indices are put in buckets of FANOUT ** LEVELS. applyInPandas collapses that many levels of each bucket, bucket roots are nodes of the
next round, and so on until a source has one node: a source of any size is dealt over many tasks, and a task holds one bucket.
Proofs come down the same rounds: the upper proof of a bucket, one row, meets the bucket's rows, and each row's proof is the
lower one, from within the bucket, followed by the upper one.

Rows with equal identifiers are ordered by their leaves; repeated rows are leaves each. A null identifier comes first and is never
tampered with. An empty table has no rows in its manifest. Columns beside the named ones are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import Stages, arrow_limits, ascii_lower
from tabelion.llm.ordered import numbered

FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """H of a row's fields."""
    told = [F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string"))) for x in fields]
    return F.sha2(F.concat(*told), 256)


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def collapse(nodes: list[str], bucket: int, fanout: int, levels: int) -> list[list[str]]:
    """The bucket's nodes level by level, its root last. Bucket 0 stops at one node: if it isn't full, it is all of its source."""
    found = [nodes]
    while len(found) <= levels and (bucket > 0 or len(found[-1]) > 1):
        below = found[-1]
        found.append([digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return found


def siblings(levels: list[list[str]], i: int, fanout: int) -> tuple[list[str], list[str]]:
    """Of the bucket's i-th node, what stands left and right of it in its run, and of its ancestors: digits, a string a level."""
    left, right = [], []
    for nodes in levels[:-1]:
        begin = i - i % fanout
        left.append("".join(nodes[begin:i]))
        right.append("".join(nodes[i + 1 : begin + fanout]))
        i //= fanout
    return left, right


def fold(node: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a node and its proof yield."""
    for a, b in zip(left, right, strict=True):
        node = hashlib.sha256((a + node + b).encode()).hexdigest()
    return node


_NODES, _PROOFS = "source string, at long, node string, more boolean", "source string, at long, left array<string>, right array<string>, subroot string"
_RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Tree:
    """All rounds of nodes above the given ones (source, at, node, ...), at counting from 0 in each source."""

    def __init__(self, stages: Stages, nodes: DataFrame, fanout: int, levels: int, label: str):
        self.stages, self.fanout, self.levels, self.label, self.size = stages, fanout, levels, label, fanout**levels
        size = self.size

        def root(pdf: pd.DataFrame) -> pd.DataFrame:
            bucket = int(pdf["at"].iloc[0]) // size
            top = collapse(pdf.sort_values("at")["node"].tolist(), bucket, fanout, levels)[-1]
            return pd.DataFrame({"source": [pdf["source"].iloc[0]], "at": [bucket], "node": top, "more": [bucket > 0 or len(pdf) == size]})

        #: Nodes of each round, and of each round the sources that end in it with their single node. A full first bucket may yet be
        #: all of its source: it goes into one more round, which leaves it as it is.
        self.rounds, self.ended = [nodes], []
        while True:
            bucketed = self.rounds[-1].select("source", "at", "node").groupBy("source", self._bucket())
            above = stages.keep(bucketed.applyInPandas(root, _NODES), f"{label}-nodes-{len(self.rounds)}")
            self.ended.append(above.where("NOT more").select("source", "node"))
            if not above.where("more").limit(1).count():
                break
            self.rounds.append(above.where("more").drop("more"))

    def _bucket(self) -> Column:
        return F.floor(F.col("at") / self.size).alias("bucket")

    def single(self) -> DataFrame:
        """(source, node) of each source."""
        found = self.ended[0]
        for more in self.ended[1:]:
            found = found.unionByName(more)
        return found

    def descend(self, tops: DataFrame, emit: Callable[[pd.DataFrame, list[list[str]], list[list[str]], str], pd.DataFrame], schema: str) -> DataFrame:
        """emit of each bucket's rows and their whole proofs, given those of the sources' single nodes: (source, left, right, subroot)."""
        fanout, levels, size = self.fanout, self.levels, self.size

        def down(emit: Callable, names: list[str]) -> Callable:
            def run(above: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
                if not len(above) or not len(pdf):
                    return pd.DataFrame({n: [] for n in names})
                pdf = pdf.sort_values("at")
                found = collapse(pdf["node"].tolist(), int(pdf["at"].iloc[0]) // size, fanout, levels)
                up = above.iloc[0]
                own = [siblings(found, i, fanout) for i in range(len(pdf))]
                return emit(pdf, [[*a, *up["left"]] for a, _ in own], [[*b, *up["right"]] for _, b in own], up["subroot"])

            return run

        above = None
        for r in reversed(range(len(self.rounds))):
            ends = tops.join(self.ended[r].select(F.col("source").alias("__source")), F.col("source").eqNullSafe(F.col("__source")), "left_semi").withColumn("at", F.lit(0).cast("long"))
            above = ends if above is None else above.unionByName(ends)
            form = _PROOFS if r else schema
            run = down(_proofs if r else emit, [c.split()[0] for c in form.split(", ")])
            above = above.groupBy("source", "at").cogroup(self.rounds[r].groupBy("source", self._bucket())).applyInPandas(run, form)
            if r:
                above = self.stages.keep(above, f"{self.label}-proofs-{r}")
        return above


def _proofs(pdf: pd.DataFrame, left: list[list[str]], right: list[list[str]], subroot: str) -> pd.DataFrame:
    return pd.DataFrame({"source": pdf["source"], "at": pdf["at"], "left": left, "right": right, "subroot": subroot})


def manifest(df: DataFrame, tampered: Column, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, changed: str = "text", to: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each row of df: leaf, subroot of its source, root, hash of its proof, and the root that its leaf yields after
    `changed` became `to` (its ASCII letters lower-cased by default) where `tampered` says so, by the original proof."""
    stages = Stages(df.sparkSession, "merkle")
    arrow_limits(df.sparkSession, 10_000)
    to = ascii_lower(F.col(changed)) if to is None else to
    after = leaf(*(to if f == changed else F.col(f) for f in fields))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), leaf(*map(F.col, fields)).alias("node"), F.when(tampered, after).alias("after"))
    tree = Tree(stages, numbered(stages, rows, "source", ["id", "node"]), fanout, levels, "rows")
    tops = numbered(stages, tree.single().select(F.lit("").alias("every"), F.col("source").alias("name"), "node"), "every", ["name"], label="sources")
    top = Tree(stages, tops.withColumnRenamed("every", "source"), fanout, levels, "sources")
    roots = top.single().select("source", "node").collect()  # one row, or none of an empty table
    root = roots[0]["node"] if roots else None
    spark = df.sparkSession
    none = spark.createDataFrame([("", [], [], root)] if roots else [], "source string, left array<string>, right array<string>, subroot string")

    def of_source(pdf: pd.DataFrame, left: list, right: list, subroot: str) -> pd.DataFrame:
        return pd.DataFrame({"source": pdf["name"], "left": left, "right": right, "subroot": pdf["node"]})

    def of_row(pdf: pd.DataFrame, left: list, right: list, subroot: str) -> pd.DataFrame:
        after = pdf["after"].where(pdf["after"].notna(), pdf["node"])
        proof = [digest([x for pair in zip(a, b, strict=True) for x in pair]) for a, b in zip(left, right, strict=True)]
        folded = [fold(n, a, b) for n, a, b in zip(after, left, right, strict=True)]
        return pd.DataFrame({id_col: pdf["id"], "leaf": pdf["node"], "subroot": subroot, "root": root, "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

    upper = stages.keep(top.descend(none, of_source, "source string, left array<string>, right array<string>, subroot string"), "upper")
    return tree.descend(upper, of_row, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {_RESULT}")
