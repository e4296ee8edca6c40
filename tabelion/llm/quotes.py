"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of > marks it begins with. Lines of one level that follow each other are a passage;
attribution lines ("... wrote:") before a passage go with it. Passages are hashed after normalising (blanks collapsed, A-Z
lower-cased) as a whole, and where they have several, by paragraphs, lines and sentences; so are the messages' bodies. The
hashes are joined within a conversation: what was said at level 0, and last before the quoting message, is the origin. A
message's parent is the origin of its shallowest linked passage; of these the coarsest match, the longest, the latest.
Messages are ordered by the turn of their thread's root, then by turn, so each follows what it replies to.

Null and empty texts have no quotes and an empty body; null turns sort first and link nothing. Of repeated (conversation,
turn) rows each is returned, and one stands for them in links. Rows with a null conversation are one conversation.
Positions are added up over stretches of at most BUCKET turns or roots, so no task sorts a whole conversation or thread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabelion.llm.common import ASCII_LOWER, Stages, arrow_limits, sent

_MARKS = re.compile(r"(?:[ \t]*>)+")
_ATTRIBUTION = re.compile(r"^(?:on\b.*\bwrote|.*\b(?:schrieb|a écrit|escribió|wrote))\s*:\s*$", re.I)
#: Turns, or roots, of one stretch when positions are counted.
BUCKET = 1_024
#: What is hashed, from coarse to fine: the whole, paragraphs, lines, sentences.
CUTS = (re.compile(r"\Z"), re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+|\n\s*\n"))
PASSAGE = pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("grain", pa.int32())])


def key(text: str) -> tuple[int, int]:
    """Hash and length of normalised text."""
    plain = b" ".join(text.encode().translate(ASCII_LOWER).split())
    return xxhash.xxh64_intdigest(plain) - (1 << 63), len(plain)


def grains(text: str) -> Iterator[tuple[int, int, int]]:
    """Hash, length and grain (place in CUTS) of a text and of its parts; each hash once, by its coarsest grain."""
    seen = set()
    for grain, cut in enumerate(CUTS):
        for part in cut.split(text):
            found, size = key(part)
            if size and found not in seen:
                seen.add(found)
                yield found, size, grain


def levels(text: str | None) -> Iterator[tuple[int, str]]:
    for line in re.split(r"\r?\n", text or ""):
        marks = _MARKS.match(line)
        yield (marks[0].count(">"), line[marks.end() :].strip()) if marks else (0, line)


def split(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message without quotes, and its passages with their levels."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for level, line in levels(text):
        if level > last:
            above = body if last == 0 else passages[-1][1]
            if above and _ATTRIBUTION.match(above[-1]):
                above.pop()
        if level == 0:
            body.append(line)
        elif level == last:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        last = level
    kept = [(level, "\n".join(lines).strip()) for level, lines in passages]
    return "\n".join(body).strip(), [(level, p) for level, p in kept if p]


def parse(df: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """df's rows with body, quoted (passages and their parts) and said (hashes of the body and its parts)."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, quoted, said, count = [], [], [], []
            for text in b.column(3).to_pylist():
                body, passages = split(text)
                rows = [(i, level, *own) for i, (level, p) in enumerate(passages) for own in grains(p)]
                bodies.append(body)
                count.append(len(passages))
                quoted.append([dict(zip(("passage", "level", "hash", "size", "grain"), r, strict=True)) for r in rows])
                said.append(sorted(h for h, *_ in grains(body)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bodies), pa.array(count, pa.int32()), pa.array(quoted, pa.list_(PASSAGE)), pa.array(said, pa.list_(pa.int64()))], names=["conv_id", "turn", "role", "body", "n_quotes", "quoted", "said"])

    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), "role", text_col).mapInArrow(
        run, f"conv_id {df.schema[conv_col].dataType.simpleString()}, turn {df.schema[turn_col].dataType.simpleString()}, role {df.schema['role'].dataType.simpleString()}, body string, n_quotes int, quoted array<struct<passage:int,level:int,hash:long,size:int,grain:int>>, said array<long>"
    )


def parents(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_linked of the messages that have linked passages."""
    # only what some message of the conversation quotes can be an origin: said hashes shrink by semi joins first
    asked = parsed.where("n_quotes > 0 and turn is not null").select(F.struct("conv_id").alias("conv"), "turn", F.explode("quoted").alias("p")).select("conv", "turn", "p.*").distinct()
    quoting = sent(asked.select("conv").distinct())
    said = parsed.where("turn is not null").withColumn("conv", F.struct("conv_id")).join(quoting, "conv", "left_semi").select("conv", "turn", F.explode("said").alias("hash")).distinct()
    said = said.join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    # as-of join by one pass in turn order: what was said last before a passage is its origin
    both = asked.unionByName(said, allowMissingColumns=True)
    before = Window.partitionBy("conv", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("origin", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)).where("level is not null and origin is not null")
    best = F.min_by("origin", F.struct("level", "grain", -F.col("size"), -F.col("origin")))
    passages = linked.groupBy("conv", "turn", "passage").agg(F.min_by(F.struct("level", "grain", "size", "origin"), F.struct("grain", -F.col("size"), -F.col("origin"))).alias("p")).select("conv", "turn", "p.*")
    return passages.groupBy("conv", "turn").agg(best.alias("parent_turn"), F.count("*").cast("int").alias("n_linked"))


def roots(links: DataFrame, stages: Stages) -> DataFrame:
    """links with root_turn and depth, by pointer doubling over the linked messages."""
    state = stages.keep(links.select("conv", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")), "links")
    while True:
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        after = stages.keep(state.join(above, ["conv", "up"], "left").select("conv", "turn", F.coalesce("higher", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("conv", "turn", F.col("up").alias("root_turn"), "depth")
        state = after.drop("moved")


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, depth, position, n_quotes, n_linked, body; position counts from 0 in reply order."""
    stages = Stages(df.sparkSession, "quotes")
    parsed = stages.keep(parse(df, conv_col, turn_col, text_col), "parsed")
    links = stages.keep(parents(parsed), "parents")
    found = sent(links.join(roots(links, stages), ["conv", "turn"]))  # messages that reply, often few
    rows = parsed.select("conv_id", "turn", "role", "body", "n_quotes", F.struct("conv_id").alias("conv")).join(found, ["conv", "turn"], "left")
    rows = rows.withColumns({"root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0))})
    # positions: rows of earlier stretches of roots, of earlier roots in the stretch, of earlier stretches of the thread, and in that;
    # keys are structs, in which nulls are equal and come first
    rows = rows.withColumns({"root": F.struct("root_turn"), "roots": F.struct(F.floor(F.col("root_turn") / BUCKET)), "turns": F.struct(F.floor(F.col("turn") / BUCKET))})
    parts = stages.keep(rows.groupBy("conv", "roots", "root", "turns").agg(F.count("*").alias("n")), "stretches")
    threads = parts.groupBy("conv", "roots", "root").agg(F.sum("n").alias("n"))
    stretches = threads.groupBy("conv", "roots").agg(F.sum("n").alias("n"))
    before = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select("conv", "roots", before("roots", "conv").alias("a"))
    threads = threads.select("conv", "roots", "root", before("root", "conv", "roots").alias("b"))
    parts = parts.select("conv", "roots", "root", "turns", before("turns", "conv", "root").alias("c"))
    parts = parts.join(threads, ["conv", "roots", "root"]).join(stretches, ["conv", "roots"]).select("conv", "root", "turns", (F.col("a") + F.col("b") + F.col("c")).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("conv", "root", "turns").orderBy("turn", "role", "body")) - 1
    placed = rows.withColumn("place", place).join(parts, ["conv", "root", "turns"])
    return placed.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", (F.col("earlier") + F.col("place")).alias("position"), "n_quotes", "n_linked", "body")
