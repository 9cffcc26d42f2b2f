"""Secret scanning: high-recall candidates, and a random forest that removes the false
positives among them."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import mix64, span_hashes, spans
from outletlens.llm.decontamination import _BREAK, _LOWER
from outletlens.llm.substring_dedup import pieces

# a candidate: at least MIN_LENGTH characters of the alphabets of keys and tokens, or what is assigned
# to a cue word or stands for the password in a URL, from MIN_VALUE characters on
MIN_LENGTH, MIN_VALUE = 12, 4
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-="]] = False
_ALPHA = np.ones(256, bool)
_ALPHA[97:123] = False
_KIND = np.full(256, 4, np.uint8)
for _lo, _hi, _k in ((48, 58, 0), (65, 91, 1), (97, 123, 2)):
    _KIND[_lo:_hi] = _k
_KIND[list(b"+/_-=")] = 3
# Words that often stand before a credential.
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "api", "auth", "credential", "access", "private", "bearer")
_CUES = re.compile("|".join(CUES).encode())  # in lower-cased text
_CUE = re.compile(rb"(?i:" + "|".join(CUES).encode() + rb")[A-Za-z0-9_-]*[\"'`]?[ \t]*$")
_VALUE = re.compile(rb"[=:]*>?[ \t]*[\"'`]?([^\s\"'`]{%d,})" % MIN_VALUE)
_LOGIN = re.compile(rb"//[^\s/:@]*:([^\s/@]{%d,})@" % MIN_VALUE)
_HEX = np.zeros((2, 256), bool)
_HEX[0, [*range(48, 58), *range(97, 103)]] = True
_HEX[1, [*range(48, 58), *range(65, 71)]] = True
_LETTER = np.full(256, 26, np.int64)  # 0 to 25, and 26 for all else
_LETTER[97:123] = np.arange(26)
BEFORE, AFTER = 40, 24  # bytes looked at on either side
SLOTS = 16  # hash slots of the words before and after, and of the path


class Corpus(NamedTuple):
    """What all texts say about words: hashes of common ones (sorted), and log probabilities of a
    letter after another."""

    words: np.ndarray
    letters: np.ndarray


def slots(h: np.ndarray) -> np.ndarray:
    return (mix64(h) % np.uint64(SLOTS)).astype(np.int64)


def describe(raw: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, path: np.ndarray,
             corpus: Corpus) -> np.ndarray:
    """One row of features for each candidate ``raw[start:end]`` of text number ``text``, for all of them at once:
    length, character kinds and their transitions, entropy, how usual its letters' order is, dictionary
    coverage, neighbouring words and signs, and the slot in ``path`` of its text's path (-1: none)."""
    n, many = end - start, len(start)
    who = np.repeat(np.arange(many), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    value = raw[at]
    kind = _KIND[value].astype(np.int64)
    share = np.bincount(who * 5 + kind, minlength=5 * many).reshape(many, 5)[:, :4] / n[:, None]
    inner = np.flatnonzero(who[1:] == who[:-1])
    moves = np.bincount(who[inner] * 25 + kind[inner] * 5 + kind[inner + 1], minlength=25 * many).reshape(many, 5, 5)[:, :4, :4]
    moves = moves.reshape(many, 16) / np.maximum(n - 1, 1)[:, None]
    byte, count = np.unique(who * 256 + value, return_counts=True)
    p = count / n[byte // 256]
    entropy = -np.bincount(byte // 256, p * np.log2(p), many)
    distinct = np.bincount(byte // 256, minlength=many) / n
    low = _LOWER[value]
    letter = _LETTER[low]
    pair = inner[(letter[inner] < 26) & (letter[inner + 1] < 26)]
    pairs = np.bincount(who[pair], minlength=many)
    usual = np.bincount(who[pair], corpus.letters[letter[pair], letter[pair + 1]], many) / np.maximum(pairs, 1)
    runs_at, runs_to, _ = spans(low, np.concatenate([[0], np.cumsum(n)]), _ALPHA)
    long = runs_to - runs_at >= 3
    runs_at, runs_to = runs_at[long], runs_to[long]
    h = span_hashes(low, runs_at, runs_to) if len(runs_at) else np.zeros(0, np.uint64)
    known = np.searchsorted(corpus.words, h, "right") > np.searchsorted(corpus.words, h)
    covered = np.bincount(who[runs_at[known]], (runs_to - runs_at)[known], many) / n
    first = np.cumsum(n) - n
    hexed = np.maximum(*(np.logical_and.reduceat(kinds[value], first) for kinds in _HEX)) if many else np.zeros(0)

    # words of the texts around the candidates
    low = _LOWER[raw]
    words_at, words_to, _ = spans(low, off, _ALPHA)
    cues = np.fromiter((m.start() for m in _CUES.finditer(low.tobytes())), np.int64)
    cued = np.zeros(len(words_at) + 1, bool)
    cued[np.searchsorted(words_at, cues, "right") - 1] = True
    lo, hi = np.maximum(off[text], start - BEFORE), np.minimum(off[text + 1], end + AFTER)
    last = np.searchsorted(words_at, start) - 1  # the last word that begins before
    cue = np.zeros(many, bool)
    for back in range(3):
        w = last - back
        ok = w >= 0
        ok[ok] = words_to[w[ok]] > lo[ok]
        cue[ok] |= cued[w[ok]]
    near = np.zeros((many, 3 * SLOTS))
    there = last >= 0
    there[there] = words_to[last[there]] > lo[there]
    rows = np.flatnonzero(there)
    if len(rows):
        near[rows, slots(span_hashes(low, words_at[last[rows]], words_to[last[rows]]))] = 1
    following = np.searchsorted(words_at, end)
    there = following < len(words_at)
    there[there] = words_at[following[there]] < hi[there]
    rows = np.flatnonzero(there)
    if len(rows):
        near[rows, SLOTS + slots(span_hashes(low, words_at[following[rows]], words_to[following[rows]]))] = 1
    rows = np.flatnonzero(path[text] >= 0)
    near[rows, 2 * SLOTS + path[text[rows]]] = 1
    before = np.where(start > lo, raw[np.maximum(start - 1, 0)], 0)
    quoted = np.isin(before, list(b"\"'`"))
    back, sign = start - 1, np.zeros(many, np.uint8)
    for _ in range(4):  # the sign before quotes and blanks
        here = np.where(back >= lo, raw[np.maximum(back, 0)], 0)
        back, sign = np.where(np.isin(here, list(b"\"'` ")), back - 1, back), here
    return np.column_stack([n, np.log(n), share, moves, entropy, distinct, usual, pairs / n, covered, hexed, cue,
                            np.isin(sign, list(b"=:")), quoted, near]).astype(np.float32)


def candidates(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every candidate, ascending."""
    start, end, first = spans(raw, off, _OUTSIDE)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    long = end - start >= MIN_LENGTH
    start, end, text = start[long], end[long], text[long]
    # "name=value" is one run of key characters: the value is what follows the sign
    equals = np.flatnonzero(raw == 61)
    if len(equals) and len(start):
        sign = equals[np.maximum(np.searchsorted(equals, end - MIN_LENGTH) - 1, 0)]
        start = np.where((sign >= start) & (sign < end - MIN_LENGTH), sign + 1, start)
    more = assigned(raw, off)
    if len(more):
        start, end, text = (np.concatenate([x, more[:, i]]) for i, x in enumerate((start, end, text)))
    order = np.unique(np.column_stack([start, end, text]), axis=0) if len(start) else np.zeros((0, 3), np.int64)
    return order[:, 0], order[:, 1], order[:, 2]


def assigned(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start, end and text of the values that follow a cue word and a sign, up to the next blank or
    quote, and of the passwords of ``scheme://user:password@host``. Only signs with a cue word
    not far before them, or two slashes behind, are looked at one by one."""
    sign = np.flatnonzero((raw == 61) | (raw == 58))
    if not len(sign):
        return np.zeros((0, 3), np.int64)
    cues = np.fromiter((m.start() for m in _CUES.finditer(_LOWER[raw].tobytes())), np.int64)
    cued = np.searchsorted(cues, sign) > np.searchsorted(cues, sign - BEFORE)
    tail = np.concatenate([raw, np.zeros(2, np.uint8)])
    login = (raw[sign] == 58) & (tail[sign + 1] == 47) & (tail[sign + 2] == 47)
    sign = sign[cued | login]
    data, out = raw.tobytes(), []
    for p, t in zip(sign.tolist(), (np.searchsorted(off, sign, "right") - 1).tolist(), strict=True):
        lo, hi = int(off[t]), int(off[t + 1])
        if data[p:p + 3] == b"://":
            m = _LOGIN.match(data, p + 1, hi)
        else:
            m = _CUE.search(data[max(lo, p - BEFORE):p]) and _VALUE.match(data, p + 1, hi)
        if m:
            out.append((m.start(1), m.start(1) + max(MIN_VALUE, len(m[1].rstrip(b",;"))), t))
    return np.array(out, np.int64).reshape(-1, 3)


def path_slot(path: str) -> int:
    return int(slots(np.array([hash_bytes(path.encode())], np.uint64))[0]) if path else -1


def hash_bytes(w: bytes) -> int:
    raw = np.frombuffer(w, np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0


def corpus_of(docs: DataFrame, share: float) -> Corpus:
    """Words that at least ``share`` of the texts hold, and how often a letter follows another, counted over
    all texts. As texts are of bounded variety, so is the words' number: (words a text) / share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, off in pieces(batch, "text"):
                low = _LOWER[raw]
                start, end, first = spans(low, off, _BREAK)
                h = span_hashes(low, start, end)
                text = np.repeat(np.arange(len(off) - 1), np.diff(first))
                _, at = np.unique(mix64(h ^ mix64(text.astype(np.uint64))), return_index=True)
                word, n = np.unique(h[at], return_counts=True)
                letter = _LETTER[low]
                pair = np.bincount(letter[:-1] * 27 + letter[1:], minlength=729)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [len(word), 729]), pa.int32()), pa.array(np.concatenate([word.view(np.int64), np.arange(729)])),
                     pa.array(np.concatenate([n, pair]).astype(np.int64))], ["kind", "item", "n"])

    least = max(2.0, share * docs.count())
    counts = docs.select("text").mapInArrow(run, "kind int, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    found = counts.filter((F.col("kind") == 1) | (F.col("n") >= least)).toArrow()
    kind, item, n = (found[c].to_numpy().astype(np.int64) for c in ("kind", "item", "n"))
    pairs = np.ones((27, 27))
    pairs.ravel()[item[kind == 1]] += n[kind == 1]
    pairs = pairs[:26, :26]
    return Corpus(np.sort(item[kind == 0].view(np.uint64)), np.log(pairs / pairs.sum(axis=1, keepdims=True)))


# Words and placeholders around credentials in generated findings.
NAMES = ("password", "passwd", "secret", "token", "api_key", "auth_token", "client_secret", "access_key")
FILLERS = ("your_api_key_here1", "xxxxxxxxxxxx1234", "example_token_123", "changeme12345", "none", "null", "true", "required", "changeme", "string",
           "os.environ")
LONG_WORDS = ("international", "responsibility", "characteristic", "understanding", "administration", "representative", "communication",
              "Massachusetts", "approximately", "environmental", "organization", "significantly", "Unfortunately", "relationship",
              "straightforward", "neighbourhood", "independently", "circumstances", "manufacturing", "INTRODUCTION")
PLAIN = ("report", "image", "table", "chapter", "section", "north", "river", "module", "window", "signal")

Finding = tuple[bytes, bytes, bytes, str, int]  # value, text before, text after, path, label


def corpus_findings(docs: DataFrame, n: int) -> list[tuple[bytes, bytes, bytes, str]]:
    """Candidates of ``n`` texts (those with the least hash) that no cue word or sign points to: what runs of key
    characters usually are in this corpus."""
    out = []
    hashed = docs.filter("text is not null").withColumn("h", F.xxhash64("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]  # only hashes are sorted
    drawn = hashed.filter(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min(F.struct("text", "path")).alias("row"))
    for (row,) in drawn.orderBy("h").select("row").collect():  # n texts at most, a parameter
        raw = np.frombuffer(row["text"].encode(), np.uint8)
        for s, e, _ in zip(*candidates(raw, np.array([0, len(raw)])), strict=True):
            before, after = raw[max(0, s - BEFORE):s].tobytes(), raw[e:e + AFTER].tobytes()
            if not _CUES.search(before.lower()) and not before.rstrip(b"\"'` ").endswith((b"=", b":")):
                out.append((raw[s:e].tobytes(), before, after, row["path"]))
    return out


def generated_findings(n: int, seed: int, usual: list[tuple[bytes, bytes, bytes, str]]) -> list[Finding]:
    """Labelled findings: credentials of usual shapes and, against them, half ``usual`` candidates of the
    corpus (as they are, in another case, or joined to each other) and half identifiers, sums, versions, numbers
    and placeholders. The text around is the corpus' own."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    alnum, hexa, marks = string.ascii_letters + digits, digits + "abcdef", "!$%&#@*?"
    draw = lambda chars, a, b=None: "".join(chars[i] for i in rng.integers(0, len(chars), a if b is None else rng.integers(a, b)))
    pick = lambda xs: xs[rng.integers(0, len(xs))]
    word = lambda: pick(PLAIN)
    assign = lambda: pick(NAMES) + pick(("=", " = ", ": ", ":")) + pick(("", '"', "'"))
    # long words fill up a small corpus' own, so that none of its candidates weighs much
    own = usual + [(pick(LONG_WORDS).encode(), (word() + pick((" the ", " of ", " and ", " an "))).encode(), (" " + word()).encode(), "")
                   for _ in range(max(0, n // 8 - len(usual)))]

    yes = (lambda: ("AKIA" + draw(upper + "234567", 16), pick(("", "the ", "key ", "aws_access_key_id = "))),
           lambda: ("ghp_" + draw(alnum, 36), pick(("", "token ", assign()))),
           lambda: (draw(hexa, 16, 48), assign()),
           lambda: (draw(alnum, 14, 44), assign()),
           lambda: ("sk_live_" + draw(alnum, 24), pick(("", "key: ", assign()))),
           lambda: (draw(lower, 6, 24), assign()),
           lambda: (draw(lower, 4, 9) + draw(digits + marks, 1, 4), assign()),
           lambda: (draw(alnum + marks, 5, 14), pick(("postgres", "https", "mysql", "ftp")) + "://" + word() + ":"),
           lambda: (word() + word() + word(), assign()))
    no = (lambda: ("-".join(draw(hexa, m) for m in (8, 4, 4, 4, 12)), pick(("id ", "uuid: ", "request "))),
          lambda: (draw(hexa, 40), pick(("commit ", "at revision ", "blob "))),
          lambda: (draw(hexa, 64), pick(("sha256 ", "digest: ", "checksum "))),
          lambda: (draw(digits, 12, 19), pick(("number ", "card ", "call ", "order ", ""))),
          lambda: (f"{word()}-{word()}-{rng.integers(1, 3000)}", pick(("see ", "the ", "in "))),
          lambda: (f"{word()}_{word()}_v{rng.integers(1, 99)}", pick(("file ", "name: ", "the "))),
          lambda: (f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}T0{rng.integers(0, 9)}", pick(("on ", "at ", "since "))),
          lambda: (pick(FILLERS), assign()),
          lambda: (pick("-=_x") * int(rng.integers(12, 60)), pick(("", "the ", "end "))),
          lambda: (f"{word()}/{word()}/{word()}", pick(("see ", "in ", "path: ", "//"))),
          lambda: (word() + pick("-_") + word() + pick("-_") + word(), pick(("the ", "a ", "in ", "name: "))))
    out: list[Finding] = []
    for i in range(n):
        value, before, after, path = pick(own)
        if i % 4 == 0:
            value = pick((value, value, value.upper(), value.lower(), value.title(), value + pick((b"", b"-", b"_")) + pick(own)[0]))
            out.append((value, before, after, path, 0))
            continue
        made, lead = pick(no if i % 4 == 2 else yes)()
        close = lead[-1:].encode() if lead[-1:] in ('"', "'") else b""
        out.append((made.encode(), before + pick((b"", b" ")) + lead.encode(), close + after, pick((path, "src", "docs", "web", "config", "")), int(i % 4 != 2)))
    return out


def described(findings: list[Finding], corpus: Corpus) -> tuple[np.ndarray, list[float]]:
    """Features and labels of findings, each in a text of its own."""
    texts = [b + v + a for v, b, a, _, _ in findings]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start = off[:-1] + np.array([len(b) for _, b, _, _, _ in findings], np.int64)
    end = start + np.array([len(v) for v, *_ in findings], np.int64)
    x = describe(np.frombuffer(b"".join(texts), np.uint8), off, start, end, np.arange(len(findings)),
                 np.array([path_slot(p) for _, _, _, p, _ in findings], np.int64), corpus)
    return x, [float(f[4]) for f in findings]


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, fit_rows: int = 6000, sample_texts: int = 600, trees: int = 40,
                 depth: int = 10, dictionary_share: float = 0.002, seed: int = 5, path_col: str = "source") -> DataFrame:
    """Candidates for credentials in all texts, with the forest's judgement.

    Candidates are runs of key characters of at least MIN_LENGTH, and values of at least MIN_VALUE
    characters of any kind but blanks and quotes that are assigned to a cue word or are the password of a
    URL, wherever they stand in the whole text. The forest is trained on ``labelled`` findings ``(value, before, after, path, label)``,
    at most ``fit_rows`` of them (a documented bound); without any, on as many generated findings of usual shapes, the negative ones
    partly the candidates of ``sample_texts`` texts that no cue points to (a bound as well). It
    is a Spark ML forest; candidates are scored where they lie. Dictionary and letter order are counted over all
    texts.

    One row per candidate: ``doc_id, start`` (byte), ``length, score`` (share of the vote for a secret) and
    ``secret`` (score of at least 0.5). Values are not returned. Null and empty texts have none, a text of one long run
    has one; findings of repeated rows and null ids are reported for each row; a null path is an empty one; other columns are
    not read; an empty table gives no rows."""
    spark = docs.sparkSession
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", path.alias("path"))
    corpus = corpus_of(rows, dictionary_share)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part, raw, off in pieces(batch, "text"):
                start, end, text = candidates(raw, off)
                if not len(start):
                    continue
                paths = np.array([known.setdefault(p, path_slot(p)) if p in known or len(known) < 10_000 else path_slot(p)
                                  for p in part.column("path").to_pylist()], np.int64)
                x = describe(raw, off, start, end, text, paths, corpus)
                at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text)), pa.array(start - off[text]), pa.array(end - start),
                     pa.ListArray.from_arrays(at, x.ravel())], ["doc_id", "start", "length", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(find, f"doc_id {kind}, start long, length long, x array<float>")
    if labelled is None:
        findings = generated_findings(fit_rows, seed, corpus_findings(rows, sample_texts))
    else:
        findings = [(bytes(r["value"], "utf-8"), bytes(r["before"] or "", "utf-8"), bytes(r["after"] or "", "utf-8"), r["path"] or "", int(r["label"]))
                    for r in labelled.filter("length(value) > 0 and label is not null").orderBy(F.xxhash64("value", "before")).limit(fit_rows).collect()]
    x, y = described(findings, corpus)
    train = spark.createDataFrame(list(zip(y, x.tolist(), strict=True)), "label double, x array<float>")
    forest = RandomForestClassifier(featuresCol="f", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(
        train.repartition(4).select("label", array_to_vector("x").alias("f")))
    scored = forest.transform(found.select("doc_id", "start", "length", array_to_vector("x").alias("f")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "length", score.alias("score"), (score >= 0.5).alias("secret"))
