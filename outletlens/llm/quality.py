"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import hash_fold, materialise, mix64, span_hashes, spans
from outletlens.llm.substring_dedup import pieces

# byte classes: blank, newline, lower, upper, digit, sentence mark, bracket or quote,
# exclamation mark, other ASCII, non-ASCII
CLASSES = 10
_CLASS = np.full(256, 8, np.uint8)
for _chars, _c in ((b" \t\r\x0b\x0c", 0), (b"\n", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3),
                   (b"0123456789", 4), (b".,;:?", 5), (b"()[]{}\"'`-", 6), (b"!", 7), (bytes(range(128, 256)), 9)):
    _CLASS[list(_chars)] = _c
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_RUN = 1 << 19  # bytes whose classes, moves and hashes are worked out at once, at some 8 bytes of memory a value
N_FEATURES = CLASSES + CLASSES * CLASSES + 9


def _repeats(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the commonest value's count, for each of ``n`` texts."""
    key = mix64(h ^ mix64(of.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else order
    text, times = of[order[new]], np.diff(np.append(new, len(key)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text, times)
    return np.bincount(text, minlength=n), most


def _runs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive spans over about ``_RUN`` bytes, one span at least."""
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _RUN, "right")))
        yield lo, hi
        lo = hi


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    for lo, hi in _runs(start, end):
        out[lo:hi] = span_hashes(raw, start[lo:hi], end[lo:hi])
    return out


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Style of whole texts: shares of byte classes and of their transitions, lengths,
    variety of words and lines. Texts without a byte are rows of zeros."""
    n = len(off) - 1
    size = np.diff(off)
    c = _CLASS[raw]
    share, move = np.empty((n, CLASSES)), np.empty((n, CLASSES**2))
    for lo, hi in _runs(off[:-1], off[1:]):
        k, x = hi - lo, c[off[lo]:off[hi]].astype(np.int64)
        of = np.repeat(np.arange(k, dtype=np.int64), size[lo:hi])
        share[lo:hi] = np.bincount(of * CLASSES + x, minlength=k * CLASSES).reshape(k, -1) / np.maximum(size[lo:hi], 1)[:, None]
        inner = of[1:] == of[:-1]
        pair = (of[1:] * CLASSES + x[:-1]) * CLASSES + x[1:]
        move[lo:hi] = np.bincount(pair[inner], minlength=k * CLASSES**2).reshape(k, -1) / np.maximum(size[lo:hi] - 1, 1)[:, None]
    start, end, first = spans(raw, off)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    kinds, most = _repeats(text, _hashes(raw, start, end), n)
    length = (end - start).astype(float)
    mean = np.bincount(text, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(text, length**2, n) / np.maximum(words, 1) - mean**2, 0))
    ls, le, lf = spans(raw, off, _NEWLINE)
    lines = np.diff(lf)
    line_kinds, _ = _repeats(np.repeat(np.arange(n), lines), _hashes(raw, ls, le), n)
    marked = np.bincount(text, (c[end - 1] >= 5) & (c[end - 1] <= 8), n) if len(end) else np.zeros(n)
    capital = np.bincount(text, c[start] == 3, n) if len(start) else np.zeros(n)
    some = np.maximum(words, 1)
    return np.column_stack([share, np.sqrt(move), np.log1p(words), mean, spread, kinds / some, most / some,
                            kinds / np.sqrt(some), line_kinds / np.maximum(lines, 1), marked / some, capital / some]
                           ) * (words > 0)[:, None]


class Net:
    """One hidden layer over standardised features, fitted with Adam."""

    def __init__(self, x: np.ndarray, hidden: int, rng: np.random.Generator):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        d = x.shape[1]
        self.p = [rng.normal(size=(d, hidden)) * (2 / d) ** 0.5, np.zeros(hidden),
                  rng.normal(size=hidden) * (1 / hidden) ** 0.5, np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def units(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(u @ self.p[0] + self.p[1], 0)
        return h, h @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.units(x))[1], -30, 30)))

    def step(self, u: np.ndarray, h: np.ndarray, dz: np.ndarray, rate: float = 2e-3, decay: float = 1e-2) -> None:
        dh = np.outer(dz, self.p[2]) * (h > 0)
        grads = [u.T @ dh + decay * self.p[0], dh.sum(axis=0), h.T @ dz + decay * self.p[2], dz.sum(keepdims=True)]
        self.t += 1
        for a, g, m, v in zip(self.p, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int, steps: int, seed: int) -> Net:
    """Minimise the non-negative PU risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with
    the logistic loss. Where the bracket is negative, the step goes against it. Without a
    prior, positives are simply told from unlabelled rows."""
    rng = np.random.default_rng(seed)
    net = Net(np.concatenate([pos, unl]), hidden, rng)
    up, uu = net.units(pos), net.units(unl)
    batch = 256
    loss = lambda q: -np.log(np.maximum(1 - q, 1e-12)).mean()  # noqa: E731  of calling rows negative
    for _ in range(steps):
        u = np.concatenate([up[rng.integers(0, len(up), batch)], uu[rng.integers(0, len(uu), batch)]])
        h, z = net.forward(u)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        sp, su = s[:batch], s[batch:]
        if prior is None:
            dz = np.concatenate([(sp - 1) / 2, su / 2]) / batch
        elif loss(su) - prior * loss(sp) >= 0:
            dz = np.concatenate([prior * (sp - 1) - prior * sp, su]) / batch
        else:
            dz = np.concatenate([prior * sp, -su]) / batch
        net.step(u, h, dz)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray, hidden: int, steps: int, seed: int) -> float:
    """The share of positives among the unlabelled rows: the least ratio of the two
    score tails, over tails that hold most held-back positives; for either half of the
    rows, a scorer that tells positives from unlabelled rows is fitted on the other half."""
    rng = np.random.default_rng(seed)
    half_p, half_u = rng.permutation(len(pos)) % 2, rng.permutation(len(unl)) % 2
    tails = []
    for k in (0, 1):
        net = fit(pos[half_p == k], unl[half_u == k], None, hidden, steps, seed)
        level = np.sort(net.score(pos[half_p != k]))
        tails.append([np.searchsorted(level, x, "right") / len(level)
                      for x in (level, net.score(unl[half_u != k]))])
    sp, su = (np.concatenate(x) for x in zip(*tails, strict=True))
    return float(np.clip(min((su > c).mean() / max((sp > c).mean(), 1e-9) for c in (0.02, 0.05, 0.1, 0.2, 0.3)), 0.01, 0.99))


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, threshold: float = 0.7, hidden: int = 16,
                  steps: int = 400, seed: int = 1, held_out: Column | None = None, carry: bool = False) -> DataFrame:
    """A quality score for every document.

    Trusted positives are documents labelled ``quality = 1`` and unlabelled web text is any
    document, neither of them held out (by default: crc32 of the id as text, modulo 4, is 2); ids,
    labels, languages and sources are no inputs of a score. The class prior is estimated, and the
    net is fitted on the driver, on about ``fit_rows`` rows of either kind drawn by a hash of the id (a
    documented bound; twice that is never passed); scoring covers all rows.

    One row per input row: ``doc_id, held_out, score`` (0 to 1), ``predicted`` (1 where the score
    reaches ``threshold``), after all columns of ``docs`` if ``carry`` is set. A text without a word has score 0. Null ids are scored, never used to
    fit; rows with repeated ids are scored one by one; extra columns are not read; without four
    positive labels all scores are 0; an empty table gives no rows."""
    rows = docs.select("doc_id", "text")
    held_out = hash_fold(F.col("doc_id")) == 2 if held_out is None else held_out
    free = rows.filter(~held_out)
    trusted = labels.filter("quality = 1").select("doc_id").distinct().withColumn("__p", F.lit(1))

    def drawn(ids: DataFrame) -> DataFrame:
        n = max(ids.count(), 1)
        share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
        return ids.filter(share < fit_rows / n).limit(2 * fit_rows)

    ids = free.select("doc_id").filter("doc_id is not null").distinct()
    known = materialise(ids.join(trusted, "doc_id", "left"))
    pick = materialise(drawn(known.filter("__p = 1")).select("doc_id", F.lit(True).alias("pos"))
                       .union(drawn(known).select("doc_id", F.lit(False))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in pieces(batch, "text"):
                x = features(raw, off).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("pos"), pa.array([r.tobytes() for r in x], pa.binary())], ["pos", "x"])

    # at most 4 x fit_rows ids: broadcast has a proven bound
    # of the texts of a repeated id the least, so that reruns fit the same net
    sample = free.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "pos").agg(F.min("text").alias("text")).select("text", "pos").mapInArrow(
        describe, "pos boolean, x binary").orderBy("pos", "x").toArrow()
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    is_pos = np.array(sample["pos"].to_pylist(), bool)
    rng = np.random.default_rng(seed)
    pos, unl = (s[rng.permutation(len(s))] for s in (x[is_pos], x[~is_pos]))
    net = None
    if len(pos) > 3 and len(unl) > 3:
        net = fit(pos, unl, estimate_prior(pos, unl, hidden, steps, seed), hidden, steps, seed)

    out = rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    at = None
    if carry:  # the row as it came, under a name that clashes with none of its own; its text is sent once
        out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        at = [c.lower() for c in docs.columns].index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if at is not None:
                batch = pa.RecordBatch.from_arrays([batch.column("row"), pc.struct_field(batch.column("row"), [at])], ["row", "text"])
            for part, raw, off in pieces(batch, "text"):
                f = features(raw, off)
                s = np.where(f.any(axis=1), net.score(f), 0.0) if net else np.zeros(len(f))
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s),
                                                  pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name != "text")
    return out.mapInArrow(judge, f"{kinds}, score double, predicted int")


def accepted_rows(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    return score_quality(docs, labels, carry=True, **params).filter("predicted = 1").select("row.*")
