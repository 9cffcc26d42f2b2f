"""Repeated word windows across all texts, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import materialise, mix64, powers, span_hashes, spans, text_bytes

SLOTS = 1 << 16  # counters of word runs, from which frequent minimisers are told
HOT = 8  # a slot counts as hot from so many times the mean
_STEP = 0xD1342543DE82EF95
_LINE = np.zeros(256, bool)
_LINE[[10, 32]] = True
# what a bucket returns: covered word ranges of row (a, b), or super-k-mers for the second level
_FOUND = "bucket int, texts binary, places binary, a long, b long, lo long, hi long"


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text (one row at least), with the bytes
    of their texts and the text offsets."""
    raw, off = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def run_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(words) - n + 1, np.uint64)
    step = 1 << 17
    for lo in range(0, len(out), step):
        w = words[lo:lo + step + n - 1]
        run = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * powers(base, len(w))[:len(w)], out=run[1:])
        out[lo:lo + step] = (run[n:] - run[:-n]) * powers(pow(base, -1, 2**64), len(w))[:len(w) - n + 1]
    return mix64(out)


def lowest_in_windows(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (n - width)], x[n - width:]) if n > width else x


def _long_texts(raw, off, n):
    """Words of the piece, their hashes, and which word starts a window of n words."""
    start, end, first = spans(raw, off)
    starts = np.zeros(len(start) + 1, np.int32)
    np.add.at(starts, np.maximum(first[:-1], 0)[np.diff(first) >= n], 1)
    np.add.at(starts, (first[1:] - n + 1)[np.diff(first) >= n], -1)
    return start, end, first, np.cumsum(starts[:-1]) > 0


def count_runs(n: int, m: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, raw, off in pieces(batch, "text"):
                start, end, first, _ = _long_texts(raw, off, n)
                if len(start) < n:
                    continue
                h = run_hashes(span_hashes(raw, start, end), m, _STEP)
                inside = np.repeat(first[1:], np.diff(first))[:len(h)] - np.arange(len(h)) >= m
                inside &= np.repeat(np.diff(first) >= n, np.diff(first))[:len(h)]
                total += np.bincount((h[inside] >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
        if total.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            parts = np.split(total, 32)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(32), pa.int32()),
                                              "counts": pa.array([pack(x.tobytes()) for x in parts], pa.binary())})
    return count


def add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in pdf["counts"])
    return pd.DataFrame({"part": pdf["part"][:1], "counts": [total.tobytes()]})


def cut_super_kmers(n: int, m: int, hot: np.ndarray, shares: np.ndarray, buckets: int, flush: int = 24 << 20):
    """Texts to super-k-mers: runs of windows with the same minimiser, as strings of their
    words, packed by bucket. Equal strings of a pack are stored once with all places. ``shares``
    holds the parts of every slot: where there are several, a pack of a bucket goes to the part
    (``salt``, else -1) that its first place draws."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        held: list = []
        size = 0

        def packed() -> pa.RecordBatch:
            bucket, parts = (np.concatenate([x[0][i] for x in held]) for i in (0, 1))
            place = np.concatenate([x[1] for x in held])
            texts = [t for x in held for t in x[2]]
            order = np.lexsort((parts, bucket))
            new = (np.diff(bucket[order], prepend=-1, append=-1) != 0) | (np.diff(parts[order], prepend=0, append=0) != 0)
            cuts = np.flatnonzero(new)
            out = ([], [], [], [])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = order[lo:hi]
                known: dict = {}
                which = np.array([known.setdefault(texts[i], len(known)) for i in rows], np.int64)
                out[0].append(int(bucket[rows[0]]))
                out[1].append(pack(b"\n".join(known)))
                out[2].append(pack(np.ascontiguousarray(np.column_stack([which, place[rows]]).T).tobytes()))
                drawn = mix64(place[rows[:1], 0].view(np.uint64))[0] % np.uint64(parts[rows[0]])
                out[3].append(int(drawn) if parts[rows[0]] > 1 else -1)
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(out[0], pa.int32()), "salt": pa.array(out[3], pa.int32()),
                                               "texts": pa.array(out[1], pa.binary()), "places": pa.array(out[2], pa.binary())})

        for batch in batches:
            for rows, raw, off in pieces(batch, "text"):
                start, end, first, starts = _long_texts(raw, off, n)
                if not starts.any():
                    continue
                h = run_hashes(span_hashes(raw, start, end), m, _STEP)
                # frequent runs come last, so that no bucket fills up around them
                h = (h >> np.uint64(1)) | (hot[(h >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
                least = lowest_in_windows(h, n - m + 1)
                at = np.flatnonzero(starts)
                least, text = least[at], np.repeat(np.arange(len(off) - 1), np.diff(first))[at]
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(least) != 0) | (np.diff(text) != 0) | (np.diff(at) != 1)
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(at)) - 1
                data, text = raw.tobytes(), text[lo]
                begin, stop = start[at[lo]].tolist(), end[at[hi] + n - 1].tolist()
                strings = [b" ".join(data[s:e].split()) for s, e in zip(begin, stop, strict=True)]
                key = np.column_stack([rows.column("a").to_numpy(), rows.column("b").to_numpy()])[text]
                slot = (least[lo] >> np.uint64(47)).astype(np.int64) & (SLOTS - 1)
                held.append((((mix64(least[lo]) % np.uint64(buckets)).astype(np.int64), shares[slot]),
                             np.column_stack([key, at[lo] - first[text]]), strings))
                size += sum(map(len, strings))
                if size > flush:
                    yield packed()
                    size = 0
        if held:
            yield packed()
    return cut


def repeated_windows(n: int):
    """All super-k-mers of a bucket to the word ranges that windows seen twice cover. Windows are
    sorted by a 64-bit hash; neighbours that agree are compared word for word. Of a salted part
    the distinct super-k-mers come out as well: those whose windows are not all found here with
    their places, the others, which need no more than to be seen by them, without."""
    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        bucket, salted = int(key[0]), len(key) > 1 and key[1] >= 0
        blobs = [unpack(x) for x in pdf["texts"]]
        lines = np.array([x.count(b"\n") + 1 for x in blobs])
        data = b"\n".join(blobs)
        del blobs
        places = [np.frombuffer(unpack(x), np.int64).reshape(4, -1) for x in pdf["places"]]
        # without places: found twice in its part
        times = np.repeat([0 if x.shape[1] else 2 for x in places], lines)
        place = np.concatenate([x + np.array([[base], [0], [0], [0]]) for x, base in
                                zip(places, np.cumsum(lines) - lines, strict=True)], axis=1)
        if salted:  # equal super-k-mers of several packs
            known: dict = {}
            which = np.array([known.setdefault(x, len(known)) for x in data.split(b"\n")], np.int64)
            data, times = b"\n".join(known), np.zeros(len(known), np.int64)
            place[0] = which[place[0]]
        times = times + np.bincount(place[0], minlength=len(times))
        raw = np.frombuffer(data, np.uint8)
        off = np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw)]])
        start, end, first = spans(raw, off, _LINE)
        words = np.diff(first)
        wh = span_hashes(raw, start, end)
        h = run_hashes(wh, n, 0x9FB21C651E98DF25)
        line = np.repeat(np.arange(len(words)), words)
        at = np.flatnonzero(first[line + 1][:len(h)] - np.arange(len(h)) >= n)  # window starts
        del wh
        order = at[np.argsort(h[at], kind="stable")]
        same = h[order][1:] == h[order][:-1]
        text = lambda i: data[start[i]:end[i + n - 1]]
        for i in np.flatnonzero(same).tolist():
            if text(order[i]) != text(order[i + 1]):
                same = None
                break
        if same is None:  # two texts share a hash: count the texts themselves
            seen = Counter()
            for i in order.tolist():
                seen[text(i)] += int(times[line[i]])
            twice = np.array([seen[text(i)] > 1 for i in order.tolist()], bool)
        else:
            group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
            twice = np.bincount(group, weights=times[line[order]])[group] > 1 if len(order) else np.zeros(0, bool)
        hit = np.zeros(len(line) + 1, bool)
        hit[order[twice]] = True
        # runs of hit window starts within a super-k-mer
        edge = np.zeros(len(hit), bool)
        edge[first[:-1]] = True
        begin = np.flatnonzero(hit[:-1] & (edge[:-1] | ~np.concatenate([[False], hit[:-2]])))
        stop = np.flatnonzero(hit[:-1] & (~hit[1:] | edge[1:]))
        of = line[begin] if len(line) else begin
        span = pd.DataFrame({"k": of, "lo": begin - first[of], "hi": stop - first[of] + n})
        occ = pd.DataFrame({"k": place[0], "a": place[1], "b": place[2], "at": place[3]})
        out = occ.merge(span, on="k")
        none = [None] * len(out)
        out = pd.DataFrame({"bucket": bucket, "texts": none, "places": none, "a": out["a"], "b": out["b"],
                            "lo": out["at"] + out["lo"], "hi": out["at"] + out["hi"]})
        out = out.astype({c: "Int64" for c in ("a", "b", "lo", "hi")})
        if salted:
            whole = np.bincount(line[at], minlength=len(words)) == np.bincount(line[order[twice]], minlength=len(words))
            strings, on = data.split(b"\n"), []
            for some in (np.flatnonzero(~whole), np.flatnonzero(whole)):
                if len(some):
                    new = np.full(len(words), -1)
                    new[some] = np.arange(len(some)) if not whole[some[0]] else -1
                    its = np.concatenate([new[place[:1]], place[1:]])[:, new[place[0]] >= 0]
                    on.append((bucket, pack(b"\n".join(strings[i] for i in some)), pack(np.ascontiguousarray(its).tobytes())))
            out = pd.concat([out, pd.DataFrame(on, columns=["bucket", "texts", "places"])], ignore_index=True)
        return out
    return find


def drop_ranges(keep_text: bool):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [])
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words = (text.as_py() or "").encode().split()
                total = len(words)
                if ranges.is_valid:
                    kept, at = [], 0
                    for r in sorted((x["lo"], x["hi"]) for x in ranges.as_py()):
                        kept += words[at:max(at, r[0])]
                        at = max(at, r[1])
                    words = kept + words[at:]
                joined = b" ".join(words)
                rows[0].append(total)
                rows[1].append(total - len(words))
                rows[2].append(hashlib.sha256(joined).hexdigest())
                rows[3].append(joined.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                 pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return drop


def remove_repeats(docs: DataFrame, window: int = 35, run: int = 4, bucket_words: int = 1_000_000,
                   id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts anywhere
    else in the texts, the same text included; judged on the input.

    A window's minimiser is the least hash among its runs of ``run`` words. One pass counts the
    runs in a fixed number of slots; runs in hot slots come last in the order, so that a passage or
    line which many texts share does not gather all their windows in one bucket. A second pass cuts
    the texts into super-k-mers and sends them to their buckets (about ``bucket_words`` windows
    each) as packed strings; equal strings of a pack travel once. In a bucket, sorting brings equal
    windows together. A hot slot with more runs than a bucket has super-k-mers is dealt over parts:
    a part settles what it sees twice, and its distinct super-k-mers, with the places of those
    not settled, meet in a second level. The covered ranges go back to the texts by a 128-bit row key.

    One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for,
    ``kept_text``. A null or empty text has no words (sha256 of the empty string); texts shorter
    than the window keep all words; repeated rows, also of one id, are places of their own, so
    their windows repeat; null ids are ordinary; other columns are not read."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                       F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(text, F.lit(1), F.col(id_col)).alias("b"))
    counts = (rows.select("text").mapInArrow(count_runs(window, run), "part int, counts binary")
              .groupBy("part").applyInPandas(add_counts, "part int, counts binary").collect())  # SLOTS numbers
    slots = np.zeros(SLOTS, np.int64)
    for part, data in counts:
        slots.reshape(32, -1)[part] = np.frombuffer(data, np.int64)
    hot = slots > HOT * max(1.0, slots.mean())
    buckets = max(64, int(slots.sum()) // bucket_words)
    # a bucket's super-k-mers, each of about half a window's length of windows
    share = max(1, int(slots.sum()) // buckets // max(1, (window - run + 1) // 2))
    shares = np.where(hot, -(-slots // share), 1)
    found = materialise(rows.select("text", "a", "b")
                        .mapInArrow(cut_super_kmers(window, run, hot, shares, buckets),
                                    "bucket int, salt int, texts binary, places binary")
                        .groupBy("bucket", "salt").applyInPandas(repeated_windows(window), _FOUND))
    rest = found.filter("texts is not null").groupBy("bucket").applyInPandas(repeated_windows(window), _FOUND)
    ranges = found.union(rest).filter("texts is null")
    ranges = materialise(ranges.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    out = "doc_id {}, n_words long, n_removed long, kept_sha256 string, kept_text string".format(
        rows.schema["doc_id"].dataType.simpleString())
    out = rows.join(ranges, ["a", "b"], "left").select("doc_id", "text", "ranges").mapInArrow(drop_ranges(keep_text), out)
    return out if keep_text else out.drop("kept_text")
