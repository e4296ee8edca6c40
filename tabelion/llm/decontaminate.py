"""Benchmark decontamination: CGK random walks, repeated bit sampling, exact edit verification, over words.

An item of n words leaks into a text if some stretch of the text is within tolerance(n) word edits of it, a fifth of n
by default. A walk copies a word sequence into 3n slots: at each slot it writes the current word and goes on to the
next one if a random bit of (slot, word) says so, which keeps sequences of small edit distance at a small Hamming
distance. Each table of the LSH samples a few slots of one walk; a window and an item are compared if all sampled
slots of some of TABLES tables agree. For each class of item lengths, the slots are chosen so that items of that class with
tolerance(n) random edits, put into a text, are found again with the target recall (lower bound of 95 %), for substitutions, insertions and deletions alone as for all mixed. Walks of long
items drift apart, so classes of CGK_WORDS words and more, and any for which no choice reaches the recall, have no
tables: all their windows are compared. Compared windows are verified by an exact alignment.

Windows are as long as the item. An edit destroys at most q runs of q words, so a stretch within the tolerance has
n - q + 1 - q tolerance(n) of the item's runs of q = min(GRAM, n / (tolerance(n) + 1)) words, nearly in line. Windows are
laid where a text has so many, in line with them: no other window can pass verification, and a run that is common to
many items lays no window by itself.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Null and empty texts and items have no words
and match nothing; repeated rows are judged each, repeated items are found each. Items are taken in blocks of
BLOCK_BYTES of text, each sent to all tasks, so a benchmark of any size is covered by more passes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import ASCII_LOWER, arrow_limits

TOLERANCE, RECALL, GRAM, SAMPLED, WALKS, BLOCK_BYTES = 0.2, 0.98, 3, 6, 6, 16 << 20
#: Slots a table samples, the first number that reaches the recall; trials of each length class.
CHOICES, TABLES, TRIALS, CGK_WORDS = (SAMPLED, 4, 3, 2), 40 * WALKS, 800, 64
#: Edits that trials consist of: mixed, substitutions, insertions, deletions.
EDITS = ((0, 1, 2), (0,), (1,), (2,))
#: Symbols embedded at once.
CELLS = 4 << 20
_SPLIT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in ASCII_LOWER)
LEAKS = "item_id long, distance int, n_words int, start_word int"
#: Slots past the end of a sequence.
END = -2


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def bits(seed: int, slot: np.ndarray | int, symbol: np.ndarray) -> np.ndarray:
    """The random bit of each (slot, symbol), the same on every machine."""
    x = (symbol.astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((slot * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(17) & np.uint64(1)).astype(np.int64)


def walk(rows: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of each row of symbols (padded to one width) in three slots a symbol."""
    at, width = np.zeros(len(rows), np.int64), rows.shape[1]
    out = np.full((len(rows), 3 * width), END, np.int64)
    every = np.arange(len(rows))
    for slot in range(3 * width):
        inside = at < lengths
        symbol = np.where(inside, rows[every, np.minimum(at, width - 1)], END)
        out[:, slot] = symbol
        at += np.where(inside, bits(seed, slot, symbol), 0)
    return out


def distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least number of word edits between the item and any stretch of the region, and where such a stretch ends.

    Bit-parallel (Myers): bit i of up and down says whether the column rises or falls at the item's word i.
    """
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    every, last = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, edits = every, 0, len(item)
    best = (edits, 0)
    for end, word in enumerate(region.tolist(), 1):
        same = places.get(word, 0)
        across = ((same & up) + up ^ up) | same
        rise, fall = down | every & ~(across | up), up & across
        edits += bool(rise & last) - bool(fall & last)
        rise, fall, stay = rise << 1, fall << 1, same | down
        up, down = (fall | ~(stay | rise)) & every, rise & stay & every
        if edits < best[0]:
            best = (edits, end)
    return best


def length_class(n: int) -> int:
    """Lengths that differ by less than half share a class."""
    return int(2 * math.log2(n))


class Items:
    """One block of the benchmark: words as numbers, runs, and the embedded items."""

    def __init__(self, rows: list[tuple[int, str | None]], tolerance: float = TOLERANCE, recall: float = RECALL):
        split = [(i, words(t)) for i, t in rows]
        split = [(i, w) for i, w in split if w]
        self.ids = [i for i, _ in split]
        self.places: dict[bytes, int] = {}
        self.items = [np.array([self.places.setdefault(w, len(self.places)) for w in ws], np.int64) for _, ws in split]
        self.allowed = [int(tolerance * len(x)) for x in self.items]
        #: Of each run length: the items' runs in order, and of each the places (item, offset) where it occurs.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.demanded = np.zeros(len(self.items), np.int64)
        of: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(self.items):
            n = min(GRAM, len(x) // (self.allowed[k] + 1))
            of[n].append(k)
            self.demanded[k] = max(1, len(x) - n + 1 - n * self.allowed[k])
        for n, ks in of.items():
            codes = [self.codes(self.items[k], n) for k in ks]
            item, offset = np.repeat(ks, [len(c) for c in codes]), np.concatenate([np.arange(len(c)) for c in codes])
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            every, begin = np.unique(code[order], return_index=True)
            self.runs[n] = every, np.append(begin, len(order)), item[order], offset[order]
        self.classes = [length_class(len(x)) for x in self.items]
        #: Of each length class: slots sampled, or None where all windows are compared.
        self.tables = {c: self.choose(c, recall) for c in sorted(set(self.classes))}

    def codes(self, x: np.ndarray, n: int) -> np.ndarray:
        """One number for each run of n words; negative where a word is not the benchmark's."""
        if len(x) < n:
            return np.zeros(0, np.int64)
        base, code = len(self.places) + 1, x[: len(x) - n + 1].copy()
        bad = code < 0
        for j in range(1, n):
            part = x[j : len(x) - n + 1 + j]
            bad |= part < 0
            code = code * base + part
        return np.where(bad, -1, code)

    def block(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(r) for r in rows])
        out = np.full((len(rows), max(1, lengths.max(initial=0))), END, np.int64)
        for r, x in zip(out, rows, strict=True):
            r[: len(x)] = x
        return out, lengths

    def slots(self, table: int, lengths: np.ndarray, sampled: int) -> np.ndarray:
        """The slots a table samples for items of these lengths."""
        share = np.random.default_rng(table).random(sampled)
        return (share[None, :] * (2 * lengths[:, None])).astype(np.int64)

    def agree(self, windows: list[np.ndarray], which: list[int], tables: range, sampled: int) -> np.ndarray:
        """Whether a window shares a bucket of some table with its item."""
        found = np.zeros(len(windows), bool)
        step = max(1, CELLS // (6 * max((len(self.items[k]) for k in which), default=1)))
        for i in range(0, len(windows), step):
            part, own = windows[i : i + step], which[i : i + step]
            rows, lengths = self.block([*part, *(self.items[k] for k in own)])
            n = np.array([len(self.items[k]) for k in own])
            for seed in sorted({t % WALKS for t in tables}):
                embedded = walk(rows, lengths, seed)
                a, b = embedded[: len(part)], embedded[len(part) :]
                for t in tables:
                    if t % WALKS == seed:
                        at = self.slots(t, n, sampled)
                        found[i : i + step] |= (np.take_along_axis(a, at, 1) == np.take_along_axis(b, at, 1)).all(1)
        return found

    def window(self, x: np.ndarray, k: int, start: int) -> np.ndarray:
        return x[max(0, start) : max(0, start + len(self.items[k]))]

    def edited(self, k: int, rng: np.random.Generator, kinds: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
        """A text that holds item k after tolerance(n) random edits of these kinds: 0 substitution, 1 insertion, 2 deletion."""
        x = list(self.items[k])
        for _ in range(self.allowed[k]):
            at, kind = rng.integers(len(x)), kinds[rng.integers(len(kinds))]
            x[at : at + (kind != 1)] = [] if kind == 2 and len(x) > 1 else [-1]
        around = [-1] * len(self.items[k])
        return np.array([*around, *x, *around], np.int64)

    def choose(self, length: int, recall: float) -> int | None:
        """The most slots with which the tables find edited items of this class with this recall, for each kind of edits and for all mixed; None if none do."""
        if length >= length_class(CGK_WORDS):
            return None
        rng = np.random.default_rng(11)
        trials = rng.choice([k for k, c in enumerate(self.classes) if c == length], TRIALS)
        pairs = []
        for t, k in enumerate(trials):
            x = self.edited(int(k), rng, EDITS[t % len(EDITS)])
            pairs += [(t, self.window(x, j, s), j) for j, s in self.candidates(x) if j == k]
        of = np.array([t for t, *_ in pairs], np.int64)
        for sampled in CHOICES:
            found = np.zeros(len(trials), bool)
            for first in range(0, TABLES, 4 * WALKS):
                left = [i for i in range(len(pairs)) if not found[of[i]]]
                ok = self.agree([pairs[i][1] for i in left], [pairs[i][2] for i in left], range(first, first + 4 * WALKS), sampled)
                found[of[left][ok]] = True
                p = np.array([found[e :: len(EDITS)].mean() for e in range(len(EDITS))])
                if (p - 1.64 * np.sqrt(p * (1 - p) * len(EDITS) / len(trials)) >= recall).all():
                    return sampled
        return None

    def candidates(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(item, window start) in line with runs that a text shares with an item, where enough of them are nearly in line.

        An edit destroys at most n runs of n words, so a stretch within the tolerance keeps demanded runs of the item, in line
        with starts no further apart than twice the tolerance.
        """
        found: list[tuple[int, int]] = []
        for n, (every, begin, item, offset) in self.runs.items():
            codes = self.codes(x, n)
            place = np.minimum(np.searchsorted(every, codes), len(every) - 1)
            at = np.flatnonzero(every[place] == codes)
            first, many = begin[place[at]], begin[place[at] + 1] - begin[place[at]]
            flat = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
            k, start = item[flat], np.repeat(at, many) - offset[flat]
            order = np.lexsort((start, k))
            k, start = k[order], start[order]
            apart = np.array(self.allowed, np.int64)[k] * 2
            # starts of one item lie together: shift items apart, then look how many starts each reaches
            line = k * (2 * (len(x) + max(map(len, self.items))) + 4 * max(self.allowed) + 4) + start
            last = np.searchsorted(line, line + apart, side="right")
            enough = last - np.arange(len(line)) >= self.demanded[k]
            covered = np.zeros(len(line) + 1, np.int64)
            np.add.at(covered, np.flatnonzero(enough), 1)
            np.add.at(covered, last[enough], -1)
            kept = np.cumsum(covered)[:-1] > 0
            found += sorted(set(zip(k[kept].tolist(), start[kept].tolist(), strict=True)))
        return sorted(found)

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """Of each text: item -> (distance, start of the verified stretch's window)."""
        known = self.places.get
        numbers = [np.fromiter((known(w, -1) for w in words(t)), np.int64) for t in texts]
        pairs = [(d, k, s) for d, x in enumerate(numbers) for k, s in self.candidates(x)] if self.items else []
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for c, sampled in self.tables.items():
            own = [p for p in pairs if self.classes[p[1]] == c]
            if sampled:
                ok = self.agree([self.window(numbers[d], k, s) for d, k, s in own], [k for _, k, _ in own], range(TABLES), sampled)
                own = [own[i] for i in np.flatnonzero(ok)]
            for d, k, s in own:
                begin = max(0, s - self.allowed[k])
                edits, _ = distance(self.items[k], numbers[d][begin : s + len(self.items[k]) + self.allowed[k]])
                if edits <= self.allowed[k]:
                    out[d][k] = min(out[d].get(k, (edits, max(0, s))), (edits, max(0, s)))
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, tolerance: float) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time."""
    size = benchmark.agg(F.sum(F.octet_length(text_col) + 64)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == b).select(item_col, text_col).orderBy(item_col, text_col).collect()
        yield Items([(r[0], r[1]) for r in rows], tolerance)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """A row (id_col, item_id, distance, n_words, start_word) for each text and item that leaked into it."""
    arrow_limits(docs.sparkSession)

    def over(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, items.ids[k], e, len(items.items[k]), s) for d, found in enumerate(items.leaks(b.column(1).to_pylist())) for k, (e, s) in sorted(found.items())]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))], names=[id_col, "item_id", "distance", "n_words", "start_word"])

        return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {LEAKS}")

    found = None
    for items in blocks(benchmark, item_col, item_text, tolerance):
        found = over(items) if found is None else found.unionByName(over(items))
    return found


def reject(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """docs without the rows that an item leaked into, all columns as they are."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index(text_col)

    def without(docs: DataFrame, items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not found for found in items.leaks(b.column(at).to_pylist())], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for items in blocks(benchmark, item_col, item_text, tolerance):
        docs = without(docs, items)
    return docs
