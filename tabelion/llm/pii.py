"""Personal data: generators of high recall, boosted trees over format and context, calibrated thresholds.

The base generators (email, ip, card, phone) are exact patterns with checks; what they find stays. Looser generators
propose further, overlapping spans: addresses written out or bracketed, phones without a plus sign, cards with other
separators. Gradient boosted trees score these from their format and the characters around them; a logistic
calibration on a held-out part turns scores into probabilities, and the least threshold with the wanted precision
there selects spans. Chosen spans don't overlap the base's or one another; the likelier goes first.

The trees are fitted here, on texts that make() writes from a seed: contexts of invented words with true spans and
with lookalikes (versions, dates, order numbers, decimals, bare digits, identifiers, file names, words with digits). No table is sampled. A
secret holds letters and digits: runs of digits alone are no secrets, whatever stands before them.

Null texts are empty. Offsets are code points, ends exclusive. Repeated rows are searched each.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabelion.llm.common import arrow_limits

#: Kinds of the base generators, and what only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Characters before the @ of an address.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can begin nowhere but at the first digit of a run, and no shorter part of a run is followed by a dot.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Written-out addresses: what stands for the @, what may be before it and what follows.
_AT = re.compile(r"\[at\]|\(at\)|\{at\}| at ", re.I)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?\Z")
_HOST = re.compile(r" ?[A-Za-z0-9-]{2,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z]{2,24}){1,4}", re.I)
#: Other looser proposals: national phones, cards with dots, slashes or wide gaps, defanged and long addresses of hosts, keys.
LOOSE = (
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])(?:00[1-9][0-9 .-]{8,20}[0-9]|\(?[0-9]{2,5}\)?(?:[ .\-/][0-9]{2,5}){1,5})(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){3}(?:[ ./_-]{1,3}[0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot ) ?[0-9]{1,3}){3}(?![0-9A-Za-z])|(?<![0-9A-Za-z:])(?:[0-9a-f]{1,4}:){3,7}:?[0-9a-f]{1,4}(?![0-9A-Za-z:])", re.I)),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_=-]{0,128}[0-9])(?=[0-9+/_=-]{0,128}[A-Za-z])[A-Za-z0-9+/_-]{16,128}={0,2}(?![A-Za-z0-9+/_=-])")),
)
_HEX = re.compile(r"[0-9a-fA-F]+")
#: Where a sentence may end within a match.
_STOP = re.compile(r"\.(?= )| (?=\.)")
GOOD = frozenset("phone tel call fax mobile reach mail e-mail email contact write card visa pay token key secret password passwd pwd api auth bearer host address ip server".split())
PLAINER = frozenset("version v isbn order date page no id ref art lei release commit sha hash digest checksum uuid etag build path time".split())
_BEFORE = re.compile(r"(?<![A-Za-z])(?:" + "|".join(sorted(GOOD | PLAINER, key=lambda w: (-len(w), w))) + r")(?![A-Za-z])", re.I)
#: Words that stand before "at" in sentences, and last labels of hosts.
PLAIN = frozenset("a all and are arrived available be but by call click contact find for found from go hosted in is it live located look looked me meet more not of on online or out page read see shop site start stay the them there this to up us visit was watch we were with you".split())
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv eu de fr es it nl br pt uk us ca au ch at be se no dk fi pl cz ru cn jp in kr mx ar".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) by start, then kind: leftmost, not overlapping within a kind, checked, without retries."""
    found = []
    at, past = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        end = at + 1
        if domain:
            begin = at
            while begin > past and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at:
                found.append((begin, 0, domain.end()))
                past = end = domain.end()
        at = text.find("@", end)
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def written_out(text: str) -> Iterator[tuple[int, int]]:
    """Spans that read like an address with its signs written out; also the part of one before a full stop in it."""
    for at in _AT.finditer(text):
        local = _LOCAL_END.search(text, max(0, at.start() - 65), at.start())
        host = local and _HOST.match(text, at.end())
        if host:
            yield local.start(), host.end()
            for cut in _STOP.finditer(text, at.end(), host.end()):
                if _HOST.fullmatch(text, at.end(), cut.start()):
                    yield local.start(), cut.start()


def proposals(text: str) -> list[tuple[int, int, int]]:
    """What the looser generators find; a card that Luhn's sum contradicts and a phone of too few digits are proposed all the same."""
    found = {(a, 0, b) for a, b in written_out(text)}
    if _DIGIT.search(text):
        for kind, pattern in LOOSE:
            found.update((m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text))
    return sorted(found)


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    digits = re.sub(r"[^0-9]", "", s)
    groups = re.findall(r"[0-9]+", s)
    near = [w.lower() for w in _BEFORE.findall(before)]
    local = _AT.split(s)[0].strip().lower() if KINDS[kind] == "email" else ""
    counts = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)[1] / len(s.encode())
    return [
        kind, end - start, len(digits), len(digits) / (end - start), len(groups), min(map(len, groups), default=0), max(map(len, groups), default=0),
        luhn(digits) if len(digits) >= 13 else -1, s.count(" "), s.count("."), s.count("-"), s.count("/"), "(" in s, "[" in s or "{" in s or "(at)" in s.lower(), " dot " in s.lower(),
        any(w in GOOD for w in near), any(w not in GOOD for w in near), before[-1:].isalnum() or before[-1:] in "/$#=", after[:1].isalnum() or after[:1] in "/%",
        len(set(digits)), digits[:1] == "0", digits[:2] in ("19", "20"), len(re.findall(r"[A-Za-z]+", s)),
        bool(_STOP.search(s)), re.split(r"[^a-z]", s.lower().rstrip())[-1] in ENDINGS, local in PLAIN, not local.isalpha(),
        float(-(counts * np.log2(counts)).sum()), sum(c.isupper() for c in s) / (end - start), bool(_HEX.fullmatch(s)), before.rstrip()[-1:] in "=:\"'", before[-1:] in "\"'", s.count(":"), s.count("_") + s.count("+"),
    ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth: at node i a row goes to 2i+1, or 2i+2 if feature > cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, inner = np.full(len(x), self.bias), self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
            total += leaf[at - inner]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss, by histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner, p = 2**depth - 1, y.mean().clip(1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    score, fs, cs, ls = np.full(len(y), bias), [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h, at = q - y, q * (1 - q), np.zeros(len(y), int)
        f, c = np.zeros(inner, int), np.full(inner, np.inf)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-6
            if len(own) >= 8:
                total_g, total_h = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    gl = np.cumsum(np.bincount(codes[own, j], g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(codes[own, j], h[own], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    if len(gain) and gain.max() > best:
                        best, f[node], c[node] = gain.max(), j, e[int(gain.argmax())]
            at[own] = 2 * node + 1 + (x[own, f[node]] > c[node])
        leaf = np.array([-rate * g[at == inner + k].sum() / (h[at == inner + k].sum() + ridge) for k in range(2**depth)])
        score += leaf[at - inner]
        fs.append(f), cs.append(c), ls.append(leaf)
    return Trees(np.array(fs), np.array(cs), np.array(ls), bias)


def written(n: int, seed: int) -> Iterator[tuple[str, int, int, bool, str]]:
    """n invented texts: where the span of each begins and ends, whether it is personal data, and its kind or an empty string."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "ti", "re", "do", "la", "es", "ch")) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + num(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    among = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa = lambda k: among("0123456789abcdef", k)
    base64 = lambda k: among("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k)
    part = lambda: str(r.randint(1, 255))

    for _ in range(n):
        yes, quote = r.random() < 0.5, ""
        if yes:
            dot = r.choice((" dot ", "[dot]", "(dot)", ".", "."))
            kind, lead, s = r.choice((
                ("phone", r.choice(("tel", "phone", "call", "mobile", word())), r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"00{r.randint(1, 9)}{num(1)} {num(3)} {num(3)} {num(3)}"))),
                ("email", r.choice(("mail", "contact", "write", word())), f"{r.choice((word(), word() + word(), f'{word()}.{word()}', f'{word()}_{word()}'))}{r.choice((' at ', ' at ', '[at]', ' (at) ', '{at}', ' [at] '))}{word()}{dot}{r.choice(('com', 'org', 'net', 'de'))}"),
                ("card", r.choice(("card", "pay", "visa", word())), (lambda c, sep: sep.join(c[i : i + 4] for i in range(0, 16, 4)))(card(), r.choice((".", "/", "  ", "_")))),
                ("ip", r.choice(("host", "address", "server", word())), r.choice((r.choice(("[.]", "(.)", "[dot]", " dot ")).join(part() for _ in range(4)), ":".join(hexa(4) for _ in range(8)), f"{hexa(4)}:{hexa(4)}:{hexa(3)}::{hexa(2)}"))),
                ("secret", r.choice(("token", "api_key", "secret", "password", "auth", "key", word())) + r.choice((" =", "=", ":", " :")), r.choice((hexa(r.choice((32, 40, 64))), hexa(40), base64(r.randint(20, 48)), "ghp_" + base64(36), "AKIA" + among("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk-" + base64(32)))),
            ))
            s = s.upper() if kind == "email" and r.random() < 0.2 else s
            quote = r.choice(("\"", "'", "\"", "")) if kind == "secret" else ""
        else:
            kind, (lead, s) = "", r.choice((
                (r.choice(("date", word())), r.choice((f"20{num(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.0{r.randint(1, 9)}.20{num(2)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/19{num(2)}"))),
                (r.choice(("version", "release", word())), f"{num(2)}.{num(2)}.{num(2)}"),
                (r.choice(("order", "ref", "no", word())), r.choice((f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(4)} {num(4)}.{num(4)} {num(4)}", f"{num(5)}-{num(2)}", f"{num(2)} {num(3)} {num(2)}"))),
                (r.choice(("page", word())), r.choice((f"{num(2)} {num(3)}", f"{num(3)} {num(4)} {num(2)}", f"{num(2)}-{num(2)}"))),
                (word(), f"{word()} at {word()} dot {word()}{word()}"), (word(), f"{word()} at {word()}. {word().title()} dot {word()}"),
                (word(), f"{r.choice((word(), word(), *sorted(PLAIN)))} at {word()}. {word().title()}"), (word(), f"{r.choice(sorted(PLAIN))} at {word()}.{r.choice(('com', 'org', 'net', 'de'))}"),
                (r.choice(("time", "at", word())), r.choice((f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}:{num(3)}:{num(2)}"))),
                (r.choice(("commit", "sha", "checksum", "etag", "hash")), hexa(r.choice((32, 40, 64)))), (r.choice(("id", "uuid", word())), "-".join(map(hexa, (8, 4, 4, 4, 12)))),
                (r.choice(("id", "no", "isbn", "order", word(), word())), r.choice((num(r.randint(12, 24)), num(16), f"{num(8)}-{num(8)}", f"{num(4)}_{num(6)}_{num(6)}"))),
                (r.choice(("id", "build", "etag", "doi", word(), word())), r.choice((f"{word()}{num(r.randint(6, 14))}", f"{word()}-{num(4)}-{word()}-{num(3)}", f"{word().title()}{word().title()}{word().title()}{num(3)}", hexa(r.choice((16, 24))), f"{num(2)}.{num(4)}/{word()}.{num(4)}.{num(3)}", f"{word()}_{word()}_{num(8)}.{r.choice(('txt', 'jpg', 'html'))}", f"20{num(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{num(2)}:{num(2)}:{num(2)}Z", f"20{num(2)}0{r.randint(1, 9)}{r.randint(10, 28)}T{num(6)}Z"))),
                (r.choice(("path", word())), r.choice((f"/{word()}/{word()}/{num(4)}/{word()}", f"{word()}-{word()}-{word()}-{num(4)}", f"{word()}_{word()}_{word()}{num(2)}", f"{word()}{word()}{word()}/{word()}-{num(1)}"))),
            ))
        before = " ".join([*(word() for _ in range(r.randint(2, 9))), lead, ""])
        stop = [". " + word().title()] if r.random() < 0.3 else []
        after = " ".join(["", *(word() for _ in range(r.randint(0, 9)))])
        before = (before[:-1] if kind == "secret" and before[-2] in "=:" and r.random() < 0.5 else before) + quote
        yield before + s + quote + "".join(stop) + after, len(before), len(before) + len(s), yes, kind


def make(n: int, seed: int) -> Iterator[tuple[str, tuple[int, int, int], bool]]:
    """Of n invented texts the proposals that meet the written span, and whether each is personal data."""
    for text, begin, end, yes, kind in written(n, seed):
        for span in proposals(text):
            if span[0] < end and span[2] > begin:
                if kind == "email":
                    yield text, span, span == (begin, KINDS.index(kind), end)
                else:
                    yield text, span, yes and span[2] - span[0] >= 0.8 * (end - begin) and not (KINDS[span[1]] == "phone" and kind == "card")


@dataclass
class Model:
    trees: Trees
    slope: float
    shift: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.raw(x) + self.shift, -60, 60)))


@functools.cache
def fit(seed: int = 7, n: int = 4000, precision: float = 0.99) -> Model:
    rows = list(make(n, seed))
    x, y = np.array([features(t, s) for t, s, _ in rows], float), np.array([float(ok) for *_, ok in rows])
    held = np.arange(len(y)) % 4 == 0
    trees = boost(x[~held], y[~held])
    raw, truth = trees.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method for the two parameters of the calibration
        q = 1 / (1 + np.exp(-np.clip(a * raw + b, -60, 60)))
        w, g = q * (1 - q) + 1e-9, q - truth
        hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * raw).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - step[0], b - step[1]
    p = 1 / (1 + np.exp(-np.clip(a * raw + b, -60, 60)))
    cuts = [c for c in np.linspace(0.5, 0.99, 50) if (p >= c).any() and truth[p >= c].mean() >= precision]
    return Model(trees, float(a), float(b), float(min(cuts, default=0.99)))


def find(texts: list[str | None], model: Model) -> list[tuple[list, list]]:
    """Of each text: base spans, and all spans, both by start, then kind."""
    out, x, of = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text or "")
        out.append((base, list(base)))
        for span in proposals(text or ""):
            if not any(a < span[2] and span[0] < b for a, _, b in base):
                x.append(features(text, span))
                of.append((k, span))
    if x:
        p = model.probability(np.array(x, float))
        for i in sorted(np.flatnonzero(p >= model.threshold), key=lambda i: (of[i][0], -p[i], of[i][1])):
            k, span = of[i]
            if not any(a < span[2] and span[0] < b for a, _, b in out[k][1]):
                out[k][1].append(span)
    return [(base, sorted(every)) for base, every in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id_col, base and spans, each array<struct<start, end, kind>>."""
    model = model or fit()
    arrow_limits(df.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    as_rows = lambda each: pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in row] for row in each], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_rows(f[0] for f in found), as_rows(f[1] for f in found)], names=[id_col, "base", "spans"])

    each = "array<struct<start:int,end:int,kind:string>>"
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, base {each}, spans {each}")


def redact(df: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """df with [KIND] in place of each span, other columns as they are; null texts stay null. Of overlapping base spans the union is cut out."""
    model = model or fit()
    arrow_limits(df.sparkSession)
    at = df.columns.index(text_col)

    def cut(text: str | None, found: list) -> str | None:
        parts, past = [], 0
        for a, k, b in found:
            if a >= past:
                parts += [text[past:a], f"[{KINDS[k].upper()}]"]
            past = max(past, b)
        return text if not found else "".join([*parts, text[past:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = pa.array([cut(t, f[1]) for t, f in zip(texts, find(texts, model), strict=True)], b.schema[at].type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
