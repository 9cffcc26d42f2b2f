"""Benchmark decontamination by latent semantic retrieval: a randomised SVD of TF-IDF
passages, cosine candidates, then common subsequences and an answer check."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletlens.llm.common import materialise, span_hashes, spans
from outletlens.llm.substring_dedup import pieces

# words: letters, digits and bytes beyond ASCII; ASCII letters in lower case
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PASSAGE = 48  # words of a passage in the corpus statistics
BLOCKS = 16
CELL = 4  # window ends lie at multiples of so many words
COMMON = 0.01  # words in more than this share of the passages have no weight


class Vocabulary:
    """The words of a block of benchmark items, found by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        bits = max(12, int(4 * len(self.hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        at = self.slot[(h >> self.shift).astype(np.int64)]
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):  # few words share a slot
            at = np.minimum(at, len(self.hashes) - 1)
            here = self.hashes[at]
            out[todo[here == h[todo]]] = at[here == h[todo]]
            more = (here < h[todo]) & (at + 1 < len(self.hashes))
            todo, at = todo[more], at[more] + 1
        return out


def read_words(raw: np.ndarray, off: np.ndarray):
    """Lower-case bytes, word spans, first word of each text, word hashes."""
    low = _LOWER[raw]
    start, end, first = spans(low, off, _BREAK)
    return low, start, end, first, span_hashes(low, start, end)


def passage_terms(vocab: Vocabulary, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted distinct (passage, word) with counts, for passages of PASSAGE words cut
    from each text; and the number of passages."""
    words = np.diff(first)
    each = -(-words // PASSAGE)
    base = np.cumsum(each) - each
    text = np.repeat(np.arange(len(words)), words)
    passage = base[text] + (np.arange(len(h)) - first[text]) // PASSAGE
    ids = vocab.ids(h)
    known = ids >= 0
    key = np.sort(passage[known] * max(len(vocab.hashes), 1) + ids[known])
    new = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    return (*np.divmod(key[new], max(len(vocab.hashes), 1)), np.diff(np.append(new, len(key))), int(each.sum()))


def count_passages(vocab: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(vocab.hashes), np.int64)
        for batch in batches:
            for _, raw, off in pieces(batch, "text"):
                _, _, _, first, h = read_words(raw, off)
                _, word, _, n = passage_terms(vocab, first, h)
                total += n
                found += np.bincount(word, minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], total))],
                                         ["word", "n"])
    return run


def sketch(vocab: Vocabulary, weight: np.ndarray, omega: np.ndarray):
    """Partial sums of A'(A omega) over the passages, rows of A of unit length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(omega.shape, np.float64)
        for batch in batches:
            for _, raw, off in pieces(batch, "text", 1 << 20):
                _, _, _, first, h = read_words(raw, off)
                passage, word, times, _ = passage_terms(vocab, first, h)
                word, passage, times = (x[weight[word] > 0] for x in (word, passage, times))
                if not len(word):
                    continue
                value = times * weight[word]
                cuts = np.flatnonzero(np.diff(passage, prepend=-1) != 0)
                row = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(passage))))
                norm = np.sqrt(np.add.reduceat(value**2, cuts))
                value = (value / np.maximum(norm, 1e-12)[row]).astype(np.float32)
                y = np.add.reduceat(omega[word] * value[:, None], cuts, axis=0)
                order = np.argsort(word, kind="stable")
                heads = np.flatnonzero(np.diff(word[order], prepend=-1) != 0)
                total[word[order][heads]] += np.add.reduceat(y[row[order]] * value[order][:, None], heads, axis=0)
        if total.any():
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(range(BLOCKS), pa.int32()),
                "part": pa.array([x.astype(np.float32).tobytes() for x in np.array_split(total, BLOCKS)], pa.binary())})
    return run


def add_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32).astype(float) for x in pdf["part"])
    return pd.DataFrame({"block": pdf["block"][:1], "part": [np.asarray(total).tobytes()]})


def right_vectors(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of A, from y = A'A omega (Nystroem)."""
    b = omega.T @ y
    val, vec = np.linalg.eigh((b + b.T) / 2)
    keep = val > 1e-9 * max(val.max(initial=0), 1e-30)
    u, _, _ = np.linalg.svd(y @ (vec[:, keep] / np.sqrt(val[keep])), full_matrices=False)
    return u[:, :rank]


def common_subsequence(masks: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence of a text of n words, given as the bit
    masks of its words' places, with ``words`` (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def search(vocab: Vocabulary, vectors: np.ndarray, items: list, cosine: float, overlap: float, answer: float, keep: list[str]):
    """Documents against items: windows a little longer than their items, moved by a
    quarter of their length, are projected; windows near an item are checked word by word."""
    groups: dict[int, list] = {}
    for item in items:  # windows an eighth longer than the item, in steps of eight words
        groups.setdefault(math.ceil(len(item["words"]) * 9 / 64) * 8, []).append(item)
    weighted = np.append(np.any(vectors != 0, axis=1), False)
    table = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])

    def near(ids: np.ndarray) -> Iterator[tuple[int, int, dict, float]]:
        """(first word, window length, item, cosine) of candidate windows of one piece."""
        at = np.flatnonzero(weighted[ids])
        n = -(-len(ids) // CELL)
        if not len(at):
            return
        heads = np.flatnonzero(np.diff(at // CELL, prepend=-1) != 0)
        cells = np.zeros((n + 1, table.shape[1]))
        cells[at[heads] // CELL + 1] = np.add.reduceat(table[ids[at]], heads, axis=0)
        np.cumsum(cells, axis=0, out=cells)
        known = np.zeros(n + 1, np.int64)
        known[1:] = np.cumsum(np.bincount(at // CELL, minlength=n))
        for size, members in sorted(groups.items()):
            width = size // CELL
            lo = np.arange(0, n, max(1, size // (4 * CELL)))
            hi = np.minimum(lo + width, n)
            # an item's window holds the asked share of its answer words
            lo, hi = (x[known[hi] - known[lo] >= min(m["needs"] for m in members)] for x in (lo, hi))
            q = np.stack([m["vector"] for m in members], axis=1)
            for k in range(0, len(lo), 8192):
                win = (cells[hi[k:k + 8192]] - cells[lo[k:k + 8192]]).astype(np.float32)
                norm = np.sqrt((win * win).sum(axis=1, keepdims=True))
                for i, j in zip(*np.nonzero(win @ q >= cosine * np.maximum(norm, 1e-9)), strict=True):
                    yield int(lo[k + i]) * CELL, size, members[j], float(win[i] @ q[:, j] / norm[i, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in pieces(batch, "text", 1 << 20):
                low, start, end, first, h = read_words(raw, off)
                ids = vocab.ids(h)
                data = low.tobytes()
                best: dict = {}
                for at, size, item, c in near(ids):
                    n = len(item["words"])
                    for text in range(int(np.searchsorted(first, at, "right")) - 1, len(off) - 1):
                        if first[text] >= min(at + size, len(h)):
                            break
                        if best.get((text, item["at"]), (0, 0, 0))[1] >= 1:
                            continue
                        lo, hi = max(first[text], at - size), min(first[text + 1], at + 2 * size)
                        words = [data[s:t] for s, t in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
                        share = common_subsequence(item["masks"], n, words) / n
                        if share < overlap:
                            continue
                        have = Counter(words)
                        told = sum(min(k, have[w]) for w, k in item["answer"].items()) / max(sum(item["answer"].values()), 1)
                        if told >= answer:
                            best[text, item["at"]] = max(best.get((text, item["at"]), (0, 0, 0)), (c, share, told), key=lambda x: x[1:])
                at = [k for k in best if k[0] >= 0]
                cols = [rows.column(c).take(pa.array([t for t, _ in at], pa.int64())) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([i for _, i in at], pa.int32()), *(pa.array([best[k][x] for k in at], pa.float64()) for x in range(3))],
                    [*keep, "at", "cosine", "overlap", "answer"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 96, cosine: float = 0.6, overlap: float = 0.6,
               answer: float = 0.5, block_items: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents that hold a benchmark passage, literally or reworded.

    The benchmark is the query set and is taken in blocks of about ``block_items`` items. Over all
    passages of all documents, one pass counts in how many each word of the block occurs, a
    second multiplies the TF-IDF matrix with a random matrix and back (sums of partitions, of a
    size fixed by vocabulary and ``rank``); its leading right singular vectors span the latent
    space. The third pass projects windows of every text, whole, and compares them with the items.
    A window within ``cosine`` of an item is a candidate; it counts if the longest common
    subsequence holds ``overlap`` of the item's words and the text around it holds ``answer`` of the words
    of its answer: the column ``answer`` of the benchmark or, where there is none, the rarest quarter
    of the item's words.

    One row per document row and item found: the ``keep`` columns, ``item_id, cosine, overlap,
    answer``. Null and empty texts hold nothing, null or wordless items are in nothing; repeated
    rows are reported each; equal items are reported each; other columns are not read; empty
    tables give no rows."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}
    n_blocks = max(1, -(-benchmark.count() // block_items))
    out = None
    for k in range(n_blocks):
        block = benchmark.withColumn("answer", F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string"))
        block = block.select("item_id", "text", "answer").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        found = _block_leaks(spark, docs.select(*keep, *([] if "text" in keep else ["text"])), block.orderBy("item_id", "text").collect(),
                             item_type, kinds, rank, cosine, overlap, answer)
        out = found if out is None else out.unionByName(found)
    return out


def _words(text: str | None) -> tuple[list[bytes], np.ndarray]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low, start, end, _, h = read_words(raw, np.array([0, len(raw)]))
    data = low.tobytes()
    return [data[s:e] for s, e in zip(start, end, strict=True)], h


def _block_leaks(spark: SparkSession, docs, block, item_type, kinds, rank, cosine, overlap, answer) -> DataFrame:
    read = [(row, *_words(row["text"])) for row in block]
    read = [r for r in read if r[1]]
    vocab = Vocabulary(np.concatenate([h for _, _, h in read]) if read else np.zeros(0, np.uint64))
    size = len(vocab.hashes)
    texts = docs.select("text")
    counts = dict(map(tuple, texts.mapInArrow(count_passages(vocab), "word int, n long").groupBy("word").agg(F.sum("n")).collect()))
    passages = counts.pop(-1, 0)
    df = np.zeros(size)
    for w, n in counts.items():
        df[w] = n
    idf = np.log((1 + passages) / (1 + df)) + 1e-3
    # rare words tell passages apart: the weight is the cube, and stop words have none, but
    # in items that have few other words
    spared = np.zeros(size, bool)
    for _, _, h in read:
        ids = vocab.ids(h)
        if (df[ids] <= COMMON * passages).sum() < 4:
            spared[ids] = True
    weight = np.where((df <= COMMON * passages) | spared, idf**3, 0.0)
    omega = np.random.default_rng(10).normal(size=(size, min(size, rank + 8))).astype(np.float32)
    parts = (texts.mapInArrow(sketch(vocab, weight, omega), "block int, part binary").groupBy("block")
             .applyInPandas(add_parts, "block int, part binary").orderBy("block").collect())  # vocabulary x (rank + 8) numbers
    y = np.concatenate([np.frombuffer(p["part"], float) for p in parts]).reshape(omega.shape) if parts else np.zeros(omega.shape)
    vectors = (weight[:, None] * right_vectors(y, omega.astype(float), rank)).astype(np.float32) if y.any() else np.zeros((size, 1), np.float32)
    items, names = [], []
    for row, words, h in read:
        v = vectors[vocab.ids(h)].sum(axis=0)
        masks: dict = {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        if row["answer"]:
            told, needs = _words(row["answer"])[0], 1
        else:
            rare = np.argsort(-idf[vocab.ids(h)], kind="stable")[:max(1, len(words) // 4)]
            told = [words[i] for i in rare]
            needs = max(1, math.ceil(answer * int((weight[vocab.ids(h)[rare]] > 0).sum()) - 1e-9))
        items.append({"at": len(items), "words": words, "vector": v / max(float(np.linalg.norm(v)), 1e-12), "masks": masks, "answer": Counter(told), "needs": needs})
        names.append((len(names), row["item_id"]))
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", at int, cosine double, overlap double, answer double"
    found = docs.mapInArrow(search(vocab, vectors, items, cosine, overlap, answer, list(kinds)), schema)
    # one row per item of the block
    named = F.broadcast(spark.createDataFrame(names, f"at int, item_id {item_type}"))
    return found.join(named, "at").select(*kinds, "item_id", "cosine", "overlap", "answer")


def clean_rows(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    key = F.struct("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tkey"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", key.alias("key"))
    leaks = find_leaks(keyed.select("text", "key"), benchmark, keep=("key",), **params)
    found = materialise(leaks.select(F.col("key").alias("leaked")).distinct())
    return keyed.join(found, F.col("key").eqNullSafe(F.col("leaked")), "left_anti").select("row.*")
