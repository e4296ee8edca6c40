"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 heavily toxic. The labels tell only toxic from clean, so toxic training rows are
graded by how many words they have that mark toxic rows in the other half of the training rows (2 from the median up). One
weight vector serves all thresholds: P(grade <= k) = sigmoid(cut_k - w.x). The expected severity is the sum over k of
P(grade >= k).

Features are the words that a text has. Those that part toxic from clean training rows with a z of MIN_Z or more are
kept (20 at least, MAX_FEATURES at most); they are counted by Spark, and only they reach the driver. The threshold is
chosen on a fold that neither features nor weights have seen.

The classifier is fitted on at most max_labelled labelled rows (half of them toxic, where there are as many), chosen by hash;
of rows with the same words one counts. Everything else covers all rows. Words are runs of letters, digits and non-ASCII
bytes, A-Z lower-cased.

Null and empty texts have no words and get the intercept's severity. Null labels count as unlabelled. Without labels
of both kinds the model is flat: severity 0, nothing rejected. Repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import ASCII_LOWER, Stages, arrow_limits

MAX_LABELLED, MAX_FEATURES, MIN_DF, MIN_Z = 8_000, 2_000, 4, 4.5
#: Fold 0 is held out; the others are the training rows, in two halves.
FOLDS = 5
#: Below this expected severity a text is likelier clean, whatever few held-out rows say.
LEAST_THRESHOLD = 0.5
#: ASCII punctuation and blanks part words.
_SPLIT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in ASCII_LOWER)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPLIT).split()


def distinct(text: str | None) -> list[bytes]:
    """A text's distinct words in the order of their hashes, so that copies and near copies mostly begin alike."""
    return sorted(set(words(text)), key=xxhash.xxh64_intdigest)


@dataclass
class Model:
    places: dict[bytes, int]
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float

    def at_least(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 of each text."""
        known = self.places.keys()
        return above(self.cuts, np.array([sum(self.weights[self.places[w]] for w in known & set(words(t))) if known else 0.0 for t in texts], float))


def above(cuts: np.ndarray, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -60, 60)))


FLAT = Model({}, np.zeros(0), np.array([60.0, 61.0]), math.inf)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, max_labelled: int, stages: Stages) -> DataFrame:
    """toxic, fold and distinct words of at most max_labelled rows, toxic and clean ones by hash; of rows with the same words one counts.

    The fold follows the least word hash, so that most near copies share one.
    """
    chosen = labels.where("toxic in (0, 1)").groupBy(F.col(label_id).alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    half = [chosen.where(F.col("__toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled // 2) for k in (0, 1)]
    few = F.broadcast(half[0].unionByName(half[1]))  # at most max_labelled rows of 12 bytes
    found = docs.join(few, docs[id_col] == F.col("__id")).select(F.col("__id").cast("string"), "__toxic", F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [distinct(t) for t in b.column(2).to_pylist()]
            group = [xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) for w in each]
            fold = [xxhash.xxh64_intdigest(w[0]) % FOLDS if w else 0 for w in each]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(each, pa.list_(pa.binary())), pa.array(group, pa.int64()), pa.array(fold, pa.int32())], names=["id", "toxic", "words", "group", "fold"])

    rows = stages.keep(found.mapInArrow(run, "id string, toxic int, words array<binary>, group long, fold int"), "sample")
    first = F.min_by(F.struct("toxic", "fold", "words"), F.struct("id", "toxic"))
    return stages.keep(rows.groupBy("group").agg(first.alias("r")).select("r.*"), "distinct")


def features(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """At most MAX_FEATURES words and their z in all training folds, in the lower ones and in the upper ones."""
    lower = F.col("fold") <= FOLDS // 2
    parts = (F.col("fold") > 0, (F.col("fold") > 0) & lower, ~lower)
    counts = [c for i, own in enumerate(parts) for c in (F.count_if(own).alias(f"n{i}"), F.count_if(own & (F.col("toxic") == 1)).alias(f"bad{i}"))]
    of = rows.agg(*counts).first()

    def z(i: int) -> Column:
        n, bad = of[f"n{i}"], of[f"bad{i}"]
        if not 0 < bad < n:
            return F.lit(0.0)
        p = F.col(f"n{i}") / n
        spread = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / bad + 1 / (n - bad)))
        return F.when(F.col(f"n{i}") >= MIN_DF, (F.col(f"bad{i}") / bad - (F.col(f"n{i}") - F.col(f"bad{i}")) / (n - bad)) / spread).otherwise(0.0)

    words = rows.select("toxic", "fold", F.explode("words").alias("word")).groupBy("word").agg(*counts)
    best = words.select("word", *(z(i).alias(f"z{i}") for i in range(3))).orderBy(F.desc(F.greatest("z0", "z1", "z2")), "word").limit(MAX_FEATURES).collect()
    found = np.array([[r["z0"], r["z1"], r["z2"]] for r in best], float).reshape(len(best), 3)
    return [bytes(r["word"]) for r in best], found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, label_id: str = "doc_id") -> Model:
    arrow_limits(docs.sparkSession)
    rows = sample(docs, labels, id_col, text_col, label_id, max_labelled, Stages(docs.sparkSession, "toxicity"))
    words, z = features(rows)
    place = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[place[w] for w in ws if w in place] for ws in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "fold", "own"])

    # at most max_labelled rows of numbers of at most MAX_FEATURES words
    coded = rows.select("toxic", "fold", "words").mapInArrow(run, "toxic int, fold int, own array<int>").toArrow()
    toxic, fold = coded["toxic"].to_numpy().astype(bool), coded["fold"].to_numpy()
    held = fold == 0
    if not words or not toxic[~held].any() or toxic[~held].all():
        return FLAT
    x = np.zeros((len(toxic), len(words)), np.float32)
    own = coded["own"].combine_chunks()
    x[np.repeat(np.arange(len(toxic)), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy()] = 1
    # a toxic row is graded by words that the other half of the training rows marks
    lower = fold <= FOLDS // 2
    marked = np.where(lower, x @ (z[:, 2] >= MIN_Z), x @ (z[:, 1] >= MIN_Z))
    grade = np.where(toxic, 1 + (marked >= max(1, np.median(marked[toxic & ~held]))), 0)
    kept = np.flatnonzero(z[:, 0] >= min(MIN_Z, np.sort(z[:, 0])[-min(20, len(z))]))
    weights, cuts = ordinal(x[~held][:, kept], grade[~held])
    severity = above(cuts, x[held][:, kept] @ weights).sum(1)
    seen = {r["toxic"]: r["n"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = seen[0] / seen[1] * toxic.sum() / max(1, (~toxic).sum())
    return Model({words[k]: i for i, k in enumerate(kept)}, weights, cuts, max(LEAST_THRESHOLD, best_threshold(severity, toxic[held], weight)))


def ordinal(x: np.ndarray, grade: np.ndarray, l2: float = 2e-5, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and two rising cuts of least penalised negative log likelihood, by Adam on the full sample."""
    p = np.concatenate([np.zeros(x.shape[1]), [0.5, 0.0]])  # weights, first cut, log of the gap
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -60, 60)))
    for t in range(1, steps + 1):
        z, c0, gap = x @ p[:-2], p[-2], np.exp(np.clip(p[-1], -6, 6))
        s0, s1 = sig(c0 - z), sig(c0 + gap - z)
        d0, d1 = s0 * (1 - s0), s1 * (1 - s1)
        like = np.select([grade == 0, grade == 1], [s0, s1 - s0], 1 - s1).clip(1e-12)
        g0 = np.select([grade == 0, grade == 1], [d0, -d0], 0.0) / like  # d log like / d first cut
        g1 = np.select([grade == 1, grade == 2], [d1, -d1], 0.0) / like
        grad = -np.concatenate([-(x.T @ (g0 + g1)) / len(z) - l2 * p[:-2], [(g0 + g1).mean(), (g1 * gap).mean()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[:-2] = p[:-2].clip(0)  # every kept word marks toxic texts: no text becomes cleaner by one more of them
    return p[:-2], np.array([p[-2], p[-2] + np.exp(np.clip(p[-1], -6, 6))])


def best_threshold(severity: np.ndarray, toxic: np.ndarray, clean_weight: float = 1.0) -> float:
    """The cut of greatest F1 on held-out rows, midway to the next lower severity; a clean row stands for clean_weight of them."""
    if not toxic.any():
        return 0.5
    order = np.argsort(-severity, kind="stable")
    s, hits = severity[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (hits + clean_weight * (np.arange(1, len(s) + 1) - hits) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, severity (expected grade), grade (most likely one), toxic (severity at or above the model's threshold)."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.at_least(b.column(1).to_pylist())
            severity = p.sum(1)
            each = np.stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity), pa.array(each.argmax(1).astype(np.int32)), pa.array(severity >= model.threshold)], names=[id_col, "severity", "grade", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, severity double, grade int, toxic boolean")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the toxic rows, all columns as they are."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.at_least(b.column(at).to_pylist()).sum(1) < model.threshold))

    return docs.mapInArrow(run, docs.schema)
