"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def katz(rows, cut=5):
    """doc_id -> (held out, tokens, known tokens, base score, score), and the training tokens."""
    texts = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    train = [w for i, w in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(x for w in train for x in w)
    c2 = Counter(p for w in train for p in zip([0, *w], w, strict=False))
    n, v = sum(c1.values()), len(c1)

    def discounts(counts):
        low = Counter(counts)
        d = {}
        tail = (cut + 1) * low[cut + 1] / low[1] if low[1] else 0
        try:
            d = {r: ((r + 1) * low[r + 1] / (r * low[r]) - tail) / (1 - tail) for r in range(1, cut + 1)} if low[1] else {}
        except ZeroDivisionError:
            d = {0: -1}
        if d and not all(0 < x <= 1 for x in d.values()):
            off = low[1] / (low[1] + 2 * low[2]) if low[2] else 0.5
            d = {r: (r - off) / r for r in range(1, cut + 1)}
        return lambda c: c * d.get(c, 1.0)

    cut1, cut2 = discounts(c1.values()), discounts(c2.values())
    room = n - sum(map(cut1, c1.values()))
    of = n if room > 1e-9 else n + 1
    unseen = (room if room > 1e-9 else 1) / max(of, 1)
    p1 = lambda w: cut1(c1[w]) / of if c1[w] else unseen
    after = defaultdict(list)
    for (h, w), c in c2.items():
        after[h].append((w, c))
    c_h, alpha = {}, {}
    for h, ws in after.items():
        total = sum(c for _, c in ws)
        kept = sum(cut2(c) for _, c in ws)
        c_h[h] = total + (kept > total - 1e-9)
        alpha[h] = (1 - kept / c_h[h]) / (1 - sum(p1(w) for w, _ in ws))
    p2 = lambda h, w: cut2(c2[h, w]) / c_h[h] if c2[h, w] else alpha.get(h, 1.0) * p1(w)
    for h in list(after)[:20]:
        assert abs(sum(p2(h, w) for w in c1) + alpha[h] * unseen - 1) < 1e-9
    out = {}
    for i, w in texts:
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c1[x] > 0 for x in w), sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(h, x)) for h, x in zip([0, *w], w, strict=False)))
    return out, n


def components(rows, k=5):
    """doc_id -> (set size, least id reachable), by all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return {i: (len(sets[i]), least[i]) for i in sets}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def threads(rows):
    """(conversation, turn) -> (parent, root, depth, position, linked passages), by comparing every passage with all that was said before.

    rows: (conversation, turn, role, body, passages), passages being (level, text), as parsed.
    """
    plain = lambda t: " ".join(t.translate(LOWER).split())
    cuts = (lambda t: [t], lambda t: re.split(r"\n\s*\n", t), lambda t: t.split("\n"), lambda t: re.split(r"(?<=[.!?])\s+|\n\s*\n", t))
    parts = lambda t: [(g, plain(p)) for g, cut in enumerate(cuts) for p in cut(t) if plain(p)]
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = {r[1]: {p for _, p in parts(r[3])} for r in own}
        parent, linked = {}, {}
        for _, turn, _, _, passages in own:
            best = []
            for level, passage in passages:
                hits = [(g, -len(p.encode()), -max(t for t in said if t < turn and p in said[t])) for g, p in parts(passage) if any(t < turn and p in said[t] for t in said)]
                if hits:
                    best.append((level, *min(hits)))
            linked[turn] = len(best)
            parent[turn] = -min(best)[3] if best else None
        chain = lambda t: [t] if parent[t] is None else [t, *chain(parent[t])]  # noqa: B023, E731
        order = sorted(own, key=lambda r: (chain(r[1])[-1], r[1]))
        for place, r in enumerate(order):
            found[conv, r[1]] = (parent[r[1]], chain(r[1])[-1], len(chain(r[1])) - 1, place, linked[r[1]])
    return found


def merkle(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            begin = i - i % fanout
            out.append((level[begin:i], level[i + 1 : begin + fanout]))
            i //= fanout
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            proof = path(trees[s], i) + path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], r[4].translate(LOWER) if r[4] is not None else None)) if tampered else leaf(r)
            for a, b in proof:
                node = h(*a, node, *b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(x for a, b in proof for x in a + b)), node, node == top[-1][0]))
    return out


def trie(rows, block=20, borrow=3):
    """(conv_id, depth, parent, members, children, leaves, saved, ends) of each node, from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest())
    own = {c: [x[1:] for x in sorted(v, key=order)] for c, v in own.items()}
    full, members, kids = {}, defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (borrow + 1)
        full[c] = tuple(own.get(c - int(math.fmod(c, block)), [])[:h] + v[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(n[-1][1])) if n else 0
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = (len(members[n]) - 1) * words + sum(saved[k] for k in kids[n])
    told = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(full[c]) == len(n)))).encode()).hexdigest()
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], told(n)) for n, m in members.items()]
