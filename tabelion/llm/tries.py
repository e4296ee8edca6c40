"""Prefix trie of conversations.

A conversation is a sequence of turns (role, text), ordered by turn (null first; turns alike by the digest of role and text; repeated rows
are turns each); null roles and texts are empty. Every conversation c is rebuilt first: it begins with the first h turns of conversation
c - c % block and goes on with its own turns after its first h. A node is a distinct sequence of first turns.

1. A prefix's identifier is the sum, over its turns, of two 64-bit hashes of (place, turn's SHA-256): it is summed in parallel
   (ordered.numbered), so neither a long conversation nor a thousand copies of one must lie in one task. Equal prefixes combine before
   the shuffle into one row a node, with its count, smallest member and words.
2. Nodes are hash-partitioned by their first turn. A first-turn subtrie of over `limit` nodes is partitioned again by the next turn,
   and so on; after BY_TURN rounds, subtries are cut in the middle of their depths instead, so that a long chain needs few
   rounds.
3. applyInPandas builds each partition's tries (nodes point to their children by dictionaries) and sums them up in iterative postorder.
   What was cut off goes first; its sums are added up per parent before they join it.

Members that end in a node are hashed in order of their identifiers: ranges of them are packed into strings by many tasks, then each
node's strings are read in order, one after the other, by one task that holds one of them at a time.

A table without conversations has no nodes. Rows without a conversation's identifier belong to no conversation. Columns beside the four
named ones are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import WORD, Stages, arrow_limits
from tabelion.llm.ordered import numbered

#: Nodes of a subtrie that is built in one piece; nodes of a partition; rounds by next turn.
LIMIT, PARTITION, BY_TURN = 100_000, 50_000, 4
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(stages: Stages, df: DataFrame, conv: str, turn: str, role: str, text: str, block: int, borrow: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (conv, n: turns) and their turns (conv, at, digest, words, last)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    told = F.concat(F.octet_length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text))
    turns = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.sha2(told, 256).alias("digest"), F.regexp_count(empty(text), F.lit(WORD)).cast("long").alias("words"))
    own = numbered(stages, turns, "conv", ["turn", "digest"], label="turns").drop("turn")
    taken = (F.crc32(F.col("conv").cast("string")) % (borrow + 1)).alias("taken")
    counts = stages.keep(own.groupBy("conv").agg(F.count("*").alias("own")), "counts")
    base = counts.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = counts.select("conv", "own", (F.col("conv") - F.col("conv") % block).alias("base"), taken).join(base, "base", "left").withColumn("got", F.least("taken", F.coalesce("there", F.lit(0))))
    convs = stages.keep(convs.withColumn("n", F.col("got") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).select("conv", "base", "taken", "got", "n"), "conversations")
    last = (F.col("at") + 1 == F.col("n")).alias("last")
    after = own.where(F.col("at") >= taken).join(convs, "conv").withColumn("at", F.col("at") - F.col("taken") + F.col("got"))
    heads = own.where(F.col("at") < borrow).withColumnRenamed("conv", "base")
    before = convs.where("got > 0").join(heads, "base").where("at < got")
    parts = [x.select("conv", "at", "digest", "words", last) for x in (before, after)]
    return convs, parts[0].unionByName(parts[1])


def prefixes(stages: Stages, turns: DataFrame) -> DataFrame:
    """A row for each turn: a, b name the prefix that ends with it, before_a, before_b the one before; depth is the prefix's length."""
    lanes = {name: F.xxhash64(F.lit(k), "digest", "at") for k, name in enumerate("ab")}
    rows = turns.withColumns(lanes).withColumnRenamed("at", "place").drop("digest")
    return numbered(stages, rows, "conv", ["place"], ["a", "b"], label="prefixes").withColumn("depth", F.col("at") + 1).drop("place", "at")


def pieces(stages: Stages, nodes: DataFrame, rows: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """nodes with the piece (key_a, key_b: its top node; top: its depth) that each is built in, and the depths of tops, deepest first."""
    heads = lambda depth: rows.where(depth).select(F.col("conv").alias("of"), F.col("depth").alias("at_depth"), F.col("a").alias("new_a"), F.col("b").alias("new_b"))
    first = heads(F.col("depth") == 1)
    cut = stages.keep(nodes.join(first, F.col("conv") == F.col("of")).withColumnsRenamed({"new_a": "key_a", "new_b": "key_b"}).withColumn("top", F.lit(1).cast("long")).drop("of", "at_depth"), "pieces")
    key, turn = ["key_a", "key_b", "top"], 0
    while True:
        large = cut.groupBy(*key).agg(F.count("*").alias("size"), F.max("depth").alias("deepest")).where((F.col("size") > limit) & (F.col("deepest") > F.col("top")))
        large = stages.keep(large.withColumn("m", F.col("top") + 1 if turn < BY_TURN else F.floor((F.col("top") + F.col("deepest") + 1) / 2)).select(*key, "m"), f"large-{turn}")
        if not large.limit(1).count():
            break
        marked = cut.join(large, key, "left")
        stay = marked.where("m IS NULL OR depth < m").drop("m")
        # the next turn of a node is its smallest member's at that depth
        depths = large.select(F.col("m").alias("wanted")).distinct()
        go = marked.where("depth >= m").join(heads(F.lit(True)).join(F.broadcast(depths), F.col("at_depth") == F.col("wanted"), "left_semi"), (F.col("conv") == F.col("of")) & (F.col("m") == F.col("at_depth")))
        go = go.withColumns({"key_a": F.col("new_a"), "key_b": F.col("new_b"), "top": F.col("m")}).select(*cut.columns)
        cut, turn = stages.keep(stay.unionByName(go), f"pieces-{turn}"), turn + 1
    return cut, sorted((r["top"] for r in cut.select("top").distinct().collect()), reverse=True)


_BUILT = "a long, b long, before_a long, before_b long, conv long, depth long, n_convs long, parent_conv long, n_children long, n_leaves long, saved long, is_top boolean"


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tries of one partition: children of each node, leaves and saved tokens of its subtree. Columns more_* are sums of what was cut off below a node."""
    own = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
    parents = list(zip(pdf["before_a"].tolist(), pdf["before_b"].tolist(), strict=True))
    index = {x: i for i, x in enumerate(own)}
    is_top = (pdf["depth"] == pdf["top"]).tolist()
    children: dict[int, dict[tuple[int, int], int]] = {}
    for i, p in enumerate(parents):
        if not is_top[i]:
            children.setdefault(index[p], {})[own[i]] = i
    n_children, leaves, saved = (pdf[c].tolist() for c in ("more_children", "more_leaves", "more_saved"))
    saved = [s + (n - 1) * w for s, n, w in zip(saved, pdf["n_convs"].tolist(), pdf["words"].tolist(), strict=True)]
    for top in (i for i, t in enumerate(is_top) if t):
        stack = [(top, iter(children.get(top, {}).values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(children.get(child, {}).values())))
                continue
            stack.pop()
            leaves[node] = leaves[node] or int(not children.get(node))
            if stack:
                up = stack[-1][0]
                n_children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    conv = pdf["conv"].tolist()
    above = pd.array([None if t else conv[index[p]] for t, p in zip(is_top, parents, strict=True)], dtype="Int64")
    out = pdf[["a", "b", "before_a", "before_b", "conv", "depth", "n_convs"]].copy()
    return out.assign(parent_conv=above, n_children=n_children, n_leaves=leaves, saved=saved, is_top=is_top)


def ends(stages: Stages, rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of rows (a, b, conv): the hash of each (a, b)'s conv, ascending, comma-joined."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(i).to_numpy() for i in range(3))
            begins = np.flatnonzero((np.diff(a, prepend=0) != 0) | (np.diff(b, prepend=0) != 0) | (np.arange(len(a)) == 0))
            ids = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(begins, np.append(begins[1:], len(a)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[begins]), pa.array(b[begins]), pa.array(conv[begins]), pa.array(ids, pa.string())], names=["a", "b", "least", "ids"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, out = None, None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

        for x in batches:
            for a, b, ids in zip(*(x.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) == now:
                    told.update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now, told.hexdigest()))
                    now, told = (a, b), hashlib.sha256(ids.encode())
            yield batch(out)
            out = []
        if now:
            yield batch([(*now, told.hexdigest())])

    packed = rows.select("a", "b", "conv").repartitionByRange(parts, "a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(pack, "a long, b long, least long, ids string")
    packed = stages.keep(packed, "ends")
    return packed.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "least").mapInArrow(add, "a long, b long, ends_sha256 string")


def trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 20, borrow: int = 3, limit: int = LIMIT, partition: int = PARTITION) -> DataFrame:
    """A row for each node: smallest member (conv_id), depth, the parent's (parent_conv_id), members, children, leaves and saved tokens of its subtree, and
    the hash of the members that end in it."""
    spark = df.sparkSession
    arrow_limits(spark, 10_000)
    stages = Stages(spark, "tries")
    convs, turns = rebuilt(stages, df, conv_col, turn_col, role_col, text_col, block, borrow)
    rows = stages.keep(prefixes(stages, turns), "rows")
    nodes = rows.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in ("before_a", "before_b", "conv", "depth", "words")), F.count("*").alias("n_convs"))
    nodes = stages.keep(nodes, "nodes")
    cut, tops = pieces(stages, nodes, rows, limit)
    hashed = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes.count() / partition))
    built = []
    more = ["more_children", "more_leaves", "more_saved"]
    for top in tops:
        here = cut.where(F.col("top") == top)
        if built:  # what was cut off below, added up for each parent
            below = None
            for x in built:
                below = x if below is None else below.unionByName(x)
            below = below.where("is_top").groupBy(F.col("before_a").alias("a"), F.col("before_b").alias("b")).agg(F.count("*").alias(more[0]), F.sum("n_leaves").alias(more[1]), F.sum("saved").alias(more[2]))
            here = here.join(below, ["a", "b"], "left").na.fill(0, more)
        else:
            here = here.withColumns({c: F.lit(0).cast("long") for c in more})
        found = here.groupBy(F.pmod(F.xxhash64("key_a", "key_b"), F.lit(hashed)).alias("bucket")).applyInPandas(lambda pdf: build(pdf), _BUILT)
        built.append(stages.keep(found, f"built-{top}"))
    one = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    sums = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    below_root = built[-1].where("is_top").agg(*sums).first() if built else (0, 1, 0)
    columns = ["a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = [(0, 0, one["conv"], 0, None, one["n"], *below_root)] if one["n"] else []
    every = spark.createDataFrame(root, ", ".join(f"{c} long" for c in columns))
    for top, x in zip(tops, built, strict=True):
        if top == 1:
            x = x.withColumn("parent_conv", F.when(F.col("is_top"), F.lit(one["conv"])).otherwise(F.col("parent_conv")))
        else:
            over = nodes.select(F.col("a").alias("before_a"), F.col("b").alias("before_b"), F.col("conv").alias("over"))
            x = x.where("is_top").join(over, ["before_a", "before_b"]).withColumn("parent_conv", F.col("over")).drop("over").unionByName(x.where("NOT is_top"))
        every = every.unionByName(x.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id", "saved": "saved_tokens"}).select(*columns))
    over = rows.where("last").select("a", "b", "conv").unionByName(convs.where("n = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv"))
    return every.join(ends(stages, over), ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).drop("a", "b")
