"""Plain statements of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = ("the river runs past the old mill and turns east below the bridge where boats wait for the tide "
         "while children throw stones from the wall and count how often each one skips over the water before dusk").split()


def text(i, n=60):
    """Some prose that differs from one number to the next."""
    return " ".join(f"{PROSE[(i * 7 + j * (i % 5 + 1)) % len(PROSE)]}{(i * 31 + j * 17) % 97}" for j in range(n))


def words(text):
    return WORD.findall(text or "")


def components(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def repeats(rows, n):
    """(id, words, removed words, sha256) of every row."""
    ws = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + n]) for w in ws for i in range(len(w) - n + 1))
    out = []
    for (key, _), w in zip(rows, ws):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def overlap(a, b, n=5):
    """Weighted Jaccard similarity of the word shingles."""
    bags = []
    for t in (a, b):
        w = words(t)
        bags.append(Counter(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter())
    return sum((bags[0] & bags[1]).values()) / max(sum((bags[0] | bags[1]).values()), 1)


def classes(rows, least=0.8):
    """Least id of the near-duplicate class of every row (ids are not null)."""
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if words(rows[i][1]) and words(rows[j][1]) and overlap(rows[i][1], rows[j][1]) >= least - 1e-9]
    comp = components(len(rows), links)
    low = defaultdict(list)
    for (key, _), c in zip(rows, comp):
        low[c].append(key)
    return [min(low[c]) for c in comp]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def targets(sizes, budget, weights=(1, 2, 3), most=3):
    """Shares by weight, capped at ``most`` times the source, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = budget - sum(most * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * weight[s] / open_ for s in order}
        over = {s for s in order if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over
