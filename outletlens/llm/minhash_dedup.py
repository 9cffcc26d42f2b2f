"""Near-duplicate documents: BagMinHash signatures of word-shingle multisets, banding,
and verification of the multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import WORD, components, materialise, mix64, span_hashes, spans, text_bytes, text_key
from outletlens.llm.substring_dedup import pieces, run_hashes

_SHINGLE = 0xA0761D6478BD642F


def shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every run of ``n`` words; a text of fewer words, but at
    least one, is one shingle as a whole."""
    start, end, first = spans(raw, off)
    words, h = np.diff(first), span_hashes(raw, start, end)
    of, out = [], []
    for k in range(1, n + 1):
        runs = run_hashes(h, k, _SHINGLE)
        if k < n:
            text = np.flatnonzero(words == k)
            at = first[text]
        else:
            text = np.repeat(np.arange(len(words)), np.maximum(words - n + 1, 0))
            at = np.flatnonzero(np.repeat(first[1:], words)[:len(runs)] - np.arange(len(runs)) >= n)
        of.append(text)
        out.append(runs[at] + np.uint64(k))
    return np.concatenate(of), np.concatenate(out)


def bag(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their multiplicities, and the rank of each occurrence
    is implied: rows come as text, shingle, count."""
    key = mix64(h ^ mix64(of.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0) if len(order) else order
    return of[order[new]], h[order[new]], np.diff(np.append(new, len(order)))


def bag_min_hash(of: np.ndarray, h: np.ndarray, w: np.ndarray, texts: int, m: int) -> np.ndarray:
    """BagMinHash registers (texts x m) of weighted elements.

    The weights are cut at 0, 1, 2, 4, 8, ...; on each piece of that hierarchy an element has a
    Poisson process whose rate is the piece's width. A point has a time, a register and a weight
    level, and counts where the level is within the element's weight, so that two texts share
    exactly the points up to the lesser of their weights. A register keeps its earliest time. The
    processes of all texts advance together; one stops when its next time is later than all
    registers of its text, which the lightest pieces reach last."""
    reg = np.full(texts * m, np.inf)
    top = np.zeros(len(w), np.int64)
    top[w > 1] = np.ceil(np.log2(w[w > 1])).astype(np.int64)
    node = np.concatenate([np.full(int((top >= j).sum()), j) for j in range(int(top.max(initial=0)) + 1)])
    at = np.concatenate([np.flatnonzero(top >= j) for j in range(int(top.max(initial=0)) + 1)])
    width = np.where(node > 0, 2.0 ** (node - 1), 1.0)
    low = np.where(node > 0, width, 0.0)
    seed = mix64(h[at] ^ mix64(node.astype(np.uint64), 1), 2)
    text, weight, time = of[at], w[at].astype(float), np.zeros(len(at))
    step = 0
    while len(seed):
        step += 1
        u = mix64(seed, 2 * step + 1)
        time = time - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
        live = time < reg.reshape(texts, m).max(axis=1)[text]
        seed, text, weight, time, width, low = (x[live] for x in (seed, text, weight, time, width, low))
        v = mix64(seed, 2 * step + 2)
        level = low + width * ((v >> np.uint64(40)).astype(float) + 1) * 2.0**-24
        ok = np.ceil(level) <= weight
        np.minimum.at(reg, (text * m + ((v & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64))[ok], time[ok])
    return reg.reshape(texts, m)


def sign(n: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in pieces(batch, "text"):
                of, h, w = bag(*shingles(raw, off, n))
                reg = bag_min_hash(of, h, w, len(off) - 1, m).view(np.uint64)
                some = np.flatnonzero(np.bincount(of, minlength=len(off) - 1) > 0)
                key = np.zeros((len(off) - 1, bands), np.uint64)
                for i in range(rows):
                    key = mix64(key ^ reg[:, i::rows], i)
                key = mix64(key ^ np.arange(bands, dtype=np.uint64))[some].view(np.int64)
                two = np.zeros((len(some), -(-m // 32) * 32), np.uint64)  # two bits of each register
                two[:, :m] = mix64(reg[some]) & np.uint64(3)
                two = (two.reshape(len(some), -1, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "tkey": part.column("tkey").take(pa.array(some)),
                    "size": pa.array(np.bincount(of, w, len(off) - 1)[some].astype(np.int64)),
                    "bands": pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), key.ravel()),
                    "sketch": pa.ListArray.from_arrays(np.arange(0, two.size + 1, two.shape[1], dtype=np.int32), two.ravel())})
    return run


def overlaps(n: int, least: float):
    """Pairs of texts whose shingle multisets overlap by ``least`` (sum of lesser over sum of
    greater multiplicities)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in pieces(batch, "tx"):
                ax, hx, wx = bag(*shingles(raw, off, n))
                (_, raw, off), = pieces(part, "ty", 1 << 62)
                ay, hy, wy = bag(*shingles(raw, off, n))
                k = part.num_rows
                both = (np.bincount(ax, wx, k) + np.bincount(ay, wy, k))
                of, key, w = np.concatenate([ax, ay]), np.concatenate([hx, hy]), np.concatenate([wx, wy])
                key = mix64(key ^ mix64(of.astype(np.uint64)))
                order = np.argsort(key, kind="stable")
                twin = np.flatnonzero(key[order][1:] == key[order][:-1])
                i, j = order[twin], order[twin + 1]
                shared = np.bincount(of[i], np.minimum(w[i], w[j]), k)
                good = np.flatnonzero(shared >= least * (both - shared) - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(good)) for c in ("x", "y")], ["x", "y"])
    return run


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``(bucket, i, j)`` of batches that are sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if held and (key[lo] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key[lo]
    if held:
        yield pa.Table.from_batches(held)


def members_of(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the shingles of each text, the k-th occurrence of a shingle being one of its own, so
    that the multiset overlap is that of sets; first place of each text."""
    of, h, w = bag(*shingles(raw, off, n))
    at = np.repeat(np.arange(len(w)), w)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(w) - w, w)
    of, h = of[at], mix64(h[at] ^ mix64(turn.astype(np.uint64), 3))
    order = np.argsort(of, kind="stable")
    return np.unique(h, return_inverse=True)[1][order], np.searchsorted(of[order], np.arange(len(off)))


def links_left(n: int, least: float, most: int):
    """Links between components in blocks of a bucket: each pair of texts of different components
    is judged by size and sketch in the block of its first common bucket, and then by its
    shingles. As what a block has linked is one component in it from then on, a block gives
    fewer rows than it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            k = block.num_rows
            comp, size, slot = (block.column(c).to_numpy() for c in ("component", "size", "slot"))
            two, keys = (block.column(c).combine_chunks().flatten().to_numpy().reshape(k, -1) for c in ("sketch", "bands"))
            two = two.view(np.uint64)
            i, j, bucket = (block.column(c)[0].as_py() for c in ("i", "j", "bucket"))
            band = int((keys[0] == bucket).argmax())
            label = np.unique(comp, return_inverse=True)[1]
            pairs = []
            for x in np.flatnonzero(slot == i).tolist():
                y = np.arange(x + 1, k) if i == j else np.flatnonzero(slot == j)
                y = y[(label[y] != label[x]) & (np.minimum(size[y], size[x]) >= least * np.maximum(size[y], size[x]) - 1e-9)]
                v = two[y] ^ two[x]
                y = y[np.bitwise_count((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64) <= most]
                y = y[(keys[y] == keys[x]).argmax(axis=1) == band]
                if len(y):
                    pairs.append((x, y))
            if not pairs:
                continue
            used = np.unique(np.concatenate([[x for x, _ in pairs], *(y for _, y in pairs)]))
            place = np.zeros(k, np.int64)
            place[used] = np.arange(len(used))
            element, first = members_of(*text_bytes(block.column("text").take(pa.array(used))), n)
            mark, a, b = np.zeros(int(element.max()) + 1, bool), [], []
            for x, y in pairs:
                y = y[label[y] != label[x]]
                if not len(y):
                    continue
                own = element[first[place[x]]:first[place[x] + 1]]
                mark[own] = True
                start, long = first[place[y]], size[y]
                begin = np.cumsum(long) - long
                shared = np.add.reduceat(mark[element[np.repeat(start - begin, long) + np.arange(long.sum())]].astype(np.int64), begin)
                mark[own] = False
                for z in y[shared >= least * (size[x] + long - shared) - 1e-9].tolist():
                    if label[z] != label[x]:
                        label[label == label[z]] = label[x]
                        a.append(comp[x])
                        b.append(comp[z])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def text_classes(docs: DataFrame, n: int, similarity: float, bands: int, rows: int, id_col: str, text_col: str,
                 leaders: int = 16, large: int = 8192, block: int = 512, block_bytes: int = 1 << 23) -> DataFrame:
    """``(doc_id, tkey, component)`` for every row, the component null for texts without words.

    Equal texts are one node. In a band's bucket the texts are not paired with one another: each is
    compared with a leader, the member that shares most buckets (the least edited copy of a
    group); then, in buckets of more than ``large`` texts that still hold several components, with
    ``leaders`` members, one of each slot of a hash that changes from round to round, until a round
    finds no link. These rounds only make components larger. What is still mixed is then compared in
    full: every pair of a bucket across components, in blocks of about ``block`` texts (or
    ``block_bytes``) against as many, which are tasks' work of bounded size. A pair is first
    judged by its sizes, which loses none, and by two bits of each register: only far below the
    threshold, by four standard deviations, it is set aside; then the texts decide."""
    text = F.col(text_col)
    rows_ = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text_key(text).alias("tkey"))
    signed = materialise(rows_.select("text", "tkey").mapInArrow(
        sign(n, bands, rows), "tkey binary, size long, bands array<long>, sketch array<long>"))
    texts = materialise(signed.groupBy("tkey").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
                        .withColumn("rid", F.monotonically_increasing_id()))
    members = texts.select("rid", "sketch", "size", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(members.join(sizes, "bucket"))
    weight = members.groupBy("rid").agg(F.sum("n").alias("mass"))
    members = materialise(members.join(weight, "rid"))
    cand = weight.join(texts, "rid").select("tkey", "rid")
    held = materialise(rows_.select("text", "tkey").join(cand, "tkey").groupBy("rid").agg(F.first("text").alias("text")))
    m = bands * rows
    unlike = 0.75 * (1 - similarity)  # two bits of a register differ for so many of them
    most = int(m * unlike + 4 * (m * unlike * (1 - unlike)) ** 0.5)

    def far(a: str, b: str) -> Column:
        """Registers whose two bits differ."""
        x = [F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i]) for i in range(-(-m // 32))]
        return sum((F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555))) for v in x), F.lit(0))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda name: held.select(F.col("rid").alias(name), F.col("text").alias(f"t{name}"))
        return (pairs.join(side("y"), "y").join(side("x"), "x")
                .select("x", "y", "tx", "ty").mapInArrow(overlaps(n, similarity), "x long, y long"))

    def mixed(at: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components."""
        some = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        return at.join(some.select("bucket"), "bucket")

    def contracted(edges: DataFrame) -> DataFrame:
        """Components of the texts after ``edges`` between components."""
        joined = components(edges).select(F.col("id").alias("component"), F.col("component").alias("up"))
        return materialise(label.join(joined, "component", "left").select("rid", F.coalesce("up", "component").alias("component")))

    turn, label = 0, weight.select("rid", F.col("rid").alias("component"))
    while True:
        # one leader in all at first, then one of each hash slot of the members
        slot = F.pmod(F.xxhash64("rid", "bucket", F.lit(turn)), F.lit(leaders if turn else 1)).alias("slot")
        at = members.withColumn("component", F.col("rid")) if turn == 0 else members.join(label, "rid")
        at = at.select("bucket", "rid", "component", "mass", "sketch", "size", "n", slot)
        if turn:
            at = materialise(mixed(at.filter(F.col("n") > large)))
        lead = at.groupBy("bucket", "slot").agg(
            F.max_by(F.struct("rid", "component", "sketch", "size"),
                     F.struct("mass" if turn == 0 else F.lit(0), F.xxhash64("rid", F.lit(turn)))).alias("l"))
        lead = lead.select("bucket", "l.*").alias("l")
        pairs = (at.alias("m").join(lead, "bucket")
                 .filter((F.col("m.component") != F.col("l.component")) & (far("m", "l") <= most)
                         & (F.least("m.size", "l.size") >= similarity * F.greatest("m.size", "l.size") - 1e-9))
                 .select(F.col("m.rid").alias("rid"), F.col("l.rid").alias("lead"))
                 .select(F.least("rid", "lead").alias("x"), F.greatest("rid", "lead").alias("y")).distinct())
        found = materialise(verified(pairs))
        if turn and not found.limit(1).count():
            break
        # links between components join them: the later rounds' few links make small tables
        of = lambda end, name: label.select(F.col("rid").alias(end), F.col("component").alias(name))
        edges = found.select(F.col("x").alias("a"), F.col("y").alias("b")) if turn == 0 else materialise(
            found.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b").distinct())
        label = contracted(edges)
        turn += 1
        if not members.filter(F.col("n") > large).limit(1).count():
            break
    # the rest in full; the leader round has compared the texts of buckets of two
    rest = mixed(members.filter("n > 2").select("bucket", "rid").join(label, "rid"))
    rest = materialise(rest.join(held, "rid").join(texts.select("rid", "bands", "sketch", "size"), "rid"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.octet_length("text")) / block_bytes)).cast("int")
    slots = F.pmod(F.xxhash64("rid", "bucket"), F.col("parts")).cast("int")
    rest = (rest.join(rest.groupBy("bucket").agg(parts.alias("parts")), "bucket").withColumn("slot", slots)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot",
                    "component", "size", "sketch", "bands", "text"))
    last = materialise(rest.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
                       .mapInArrow(links_left(n, similarity, most), "a long, b long"))
    if last.limit(1).count():
        label = contracted(last)
    ids = texts.select("tkey", "rid").join(label, "rid", "left").select(
        "tkey", F.coalesce("component", "rid").alias("component"))
    return rows_.select("doc_id", "tkey").join(ids, "tkey", "left")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 30, rows: int = 6,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate texts: links are pairs of texts whose multisets of word
    shingles have a weighted Jaccard similarity of at least ``similarity``; classes are the
    connected components, equal texts included.

    One row per input row: ``doc_id, class_id`` (least id of the class), ``kept`` (id equals
    class_id), ``tkey`` (key of the text) and ``component`` (a number of the class, null without words;
    unlike ``class_id`` it tells classes apart whose ids are null or repeated). Null texts and texts without a word are classes of
    their own, one each; a text of fewer words than a shingle is one shingle; a null id yields to any id
    of its class; repeated rows are copies; other columns are not read; an empty table gives no
    rows."""
    rows_ = materialise(text_classes(docs, shingle, similarity, bands, rows, id_col, text_col))
    least = rows_.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    out = rows_.join(least, "component", "left")
    class_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept"), "tkey", "component")


def one_per_class(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` with one row of every class: the least id (null only where the class has
    no other) and, among rows of that id in the class, the least text key; of rows that agree in
    both, the least in the order of the columns. Rows without words all stay."""
    got = near_duplicates(docs, **params)
    chosen = (got.filter("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("k"))
        .select(F.struct("k.doc_id", "k.tkey").alias("__k")))
    keyed = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("tkey")).alias("key"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = keyed.join(chosen, F.col("key").eqNullSafe(F.col("__k"))).groupBy("key").agg(F.min("row").alias("row")).select("row.*")
    return kept.unionByName(docs.filter(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0))
