"""URL filter: rules first, then a path-template tree of each host. DataFrame functions only.

Pages shrink to (host, segment shapes) with counts; the tree is built on those, from the root, to any depth:

* a segment whose shape is lexically variable (digits, hexadecimal, mixed) becomes a wildcard of that shape;
* a node's literal children without labels become one wildcard {*} if they hardly repeat (fewer than REPEATED pages a child);
* literal children whose counts of child shapes are what one distribution, the siblings' together, may well give (a
  chi-squared test at 1 %), and, where they are labelled, whose label rates are what the siblings' together may give, are merged under
  the name of the least one, marked ~. Labelled and unlabelled siblings are compared alike and pool their labels.

A round names the next branching segment of every node; what no branch can change (segments that all paths of a node share, and all of a
node's only path) is named at once. So rounds are as many as branchings lie on one path, not as segments do.

A template is rejected if it has at least min_labelled labelled pages and its share of bad ones, smoothed towards
its host's and that towards prior, reaches threshold. Segments that begin with a brace or a backslash are written with a backslash before, so that
none reads like a wildcard.

A null url and one without :// have an empty host and path, and are allowed by the method. Repeated rows each count
and each get a verdict. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import Stages, ascii_lower

REPEATED, MIN_LABELLED, SMOOTHING, PRIOR, THRESHOLD = 2.0, 5, 2.0, 0.1, 0.9
#: The normal deviate of the 1 % that a test may err by.
DEVIATE = 2.326
#: Lexical shapes of variable segments, tried in this order.
SHAPES = (("{num}", r"^[0-9]+$"), ("{num.ext}", r"^[0-9]+\.[A-Za-z]+$"), ("{hex}", r"^[0-9a-fA-F-]{16,}$"), ("{id}", r"[0-9]"), ("{end}", r"^$"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.when(has, url.substr(F.length(rest) + 4, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null without one. rules: "host/path" -> action; a short, fixed list."""
    rule = action = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(action)
    return rule, action


def shape(segment: Column) -> Column:
    found = F.when(segment.rlike(r"^[{\\\\]"), F.concat(F.lit("\\"), segment)).otherwise(segment)
    for name, pattern in reversed(SHAPES):
        found = F.when(segment.rlike(pattern), name).otherwise(found)
    return found


def shapes(path: Column) -> Column:
    return F.transform(F.slice(F.split(path, "/"), 2, 1 << 30), shape)


def literal(segment: Column) -> Column:
    return ~segment.startswith("{")


def critical(freedom: Column) -> Column:
    """What a chi-squared statistic exceeds in 1 % of samples, by Wilson and Hilferty; 0 without freedom."""
    part = 2 / (9 * F.greatest(freedom, F.lit(1)))
    return F.when(freedom > 0, freedom * F.pow(1 - part + DEVIATE * F.sqrt(part), F.lit(3))).otherwise(0.0) + 1e-6


def branches(level: DataFrame, stages: Stages) -> DataFrame:
    """host, template, segment and the branch that each literal segment of a level goes to."""
    node = ["host", "template"]
    below = F.coalesce(F.get("rest", F.lit(1)), F.lit("{none}"))
    kinds = level.where(literal(F.col("segment"))).groupBy(*node, "segment", F.when(literal(below), "{literal}").otherwise(below).alias("below"))
    kinds = stages.keep(kinds.agg(F.sum("n").alias("n"), F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad")), "kinds")
    children = kinds.groupBy(*node, "segment").agg(F.sum("n").alias("of"), F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
    pooled = kinds.groupBy(*node, "below").agg(F.sum("n").alias("pool"))
    freedom = pooled.groupBy(*node).agg((F.count("*") - 1).alias("freedom"))
    totals = children.groupBy(*node).agg(F.sum("of").alias("all"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count_if(F.col("l") == 0).alias("plain"), F.sum(F.when(F.col("l") == 0, F.col("of"))).alias("all_plain")).join(freedom, node)
    expected = F.col("of") * F.col("pool") / F.col("all")
    tested = (
        kinds.select(*node, "segment", "below", "n").join(children, [*node, "segment"]).join(totals, node).join(pooled, [*node, "below"])
        .groupBy(*node, "segment", "of", "l", "b", "all", "all_l", "all_b", "plain", "all_plain", "freedom").agg(F.sum(F.col("n") * F.col("n") / expected).alias("ratio"))
    )
    rate = F.col("all_b") / F.greatest("all_l", F.lit(1))
    spread = F.col("l") * rate * (1 - rate)
    alike = (F.col("ratio") - F.col("of") <= critical(F.col("freedom"))) & (F.pow(F.col("b") - F.col("l") * rate, F.lit(2)) <= DEVIATE * DEVIATE * spread + 1e-6)
    variable = (F.col("l") == 0) & (F.col("plain") > 1) & (F.col("all_plain") < REPEATED * F.col("plain"))
    tested = stages.keep(tested.select(*node, "segment", (alike & ~variable).alias("alike"), variable.alias("variable")), "children")
    merged = tested.where("alike").groupBy(*node).agg(F.min("segment").alias("least"), F.count("*").alias("together"))
    branch = F.when(F.col("variable"), "{*}").when(F.col("alike") & (F.col("together") > 1), F.concat("least", F.lit("~"))).otherwise(F.col("segment"))
    return tested.join(merged, node, "left").select(*node, "segment", branch.alias("branch"))


def named_at_once(tree: DataFrame) -> DataFrame:
    """Templates as far as no branch can change them: all of a node's only path, else what the rests of the node's paths begin with alike."""
    same = F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b))
    common = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size("least"))
    nodes = tree.groupBy("host", "template").agg(F.count("*").alias("paths"), F.min("rest").alias("least"), F.max("rest").alias("most"))
    nodes = nodes.select("host", "template", F.when(F.col("paths") > 1, common).alias("alike"))
    known = tree.join(nodes, ["host", "template"]).withColumn("alike", F.coalesce("alike", F.size("rest")).cast("int"))
    told = F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("alike")), lambda x: F.concat(F.lit("/"), x)), "")
    return known.withColumns({"template": F.concat("template", told), "rest": F.slice("rest", F.col("alike") + 1, F.lit(1 << 30))}).drop("alike")


def templates(leaves: DataFrame, stages: Stages) -> DataFrame:
    """leaves (host, shapes, n, n_labelled, n_bad) with the template of each. Each round is written, for the next reads it more than once."""
    tree, done, names = leaves.withColumns({"template": F.lit(""), "rest": F.col("shapes")}), [], leaves.columns
    while True:
        tree = stages.keep(named_at_once(tree), "tree")
        done.append(stages.path("done"))
        tree.where(F.size("rest") == 0).select(*names, "template").write.parquet(done[-1])
        level = tree.where(F.size("rest") > 0)
        if not level.limit(1).count():
            return stages.spark.read.schema(tree.select(*names, "template").schema).parquet(*done)
        named = level.withColumn("segment", F.get("rest", F.lit(0)))
        named = named.join(branches(named, stages), ["host", "template", "segment"], "left")
        tree = named.withColumns({"template": F.concat("template", F.lit("/"), F.coalesce("branch", "segment")), "rest": F.slice("rest", F.lit(2), F.lit(1 << 30))}).drop("branch", "segment")


def judge(df: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", bad: Column | None = None, threshold: float = THRESHOLD, min_labelled: int = MIN_LABELLED) -> DataFrame:
    """id_col, host, path, rule, verdict, template, purity for each row.

    bad: a nullable boolean over df's columns, the label of a page; without it the rules' own verdicts are the labels.
    """
    host, path = split_url(F.col(url_col))
    pages = df.select(F.col(id_col), host.alias("host"), path.alias("path"), (bad if bad is not None else F.lit(None).cast("boolean")).alias("bad"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "action": action, "shapes": shapes(F.col("path"))})
    label = F.col("bad") if bad is not None else F.col("action") == "block"
    stages = Stages(df.sparkSession, "url-filter")
    leaves = pages.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.count(label).alias("n_labelled"), F.count_if(label).alias("n_bad"))
    leaves = stages.keep(leaves, "leaves")
    tree = templates(leaves, stages)
    hosts = leaves.groupBy("host").agg(((F.sum("n_bad") + SMOOTHING * PRIOR) / (F.sum("n_labelled") + SMOOTHING)).alias("host_purity"))
    pure = (
        tree.groupBy("host", "template").agg(F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad")).join(hosts, "host")
        .select("host", "template", ((F.col("n_bad") + SMOOTHING * F.col("host_purity")) / (F.col("n_labelled") + SMOOTHING)).alias("purity"), "n_labelled")
    )
    verdicts = tree.select("host", "shapes", "template").join(pure, ["host", "template"])
    rejected = (F.col("purity") >= threshold) & (F.col("n_labelled") >= min_labelled)
    return pages.join(verdicts, ["host", "shapes"], "left").select(id_col, "host", "path", "rule", F.coalesce("action", F.when(rejected, "block").otherwise("allow")).alias("verdict"), "template", "purity")
