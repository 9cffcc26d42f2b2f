"""Licence paragraphs: a trained n-gram classifier with a calibrated unknown class,
confirmed by comparison with templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import span_hashes, spans
from outletlens.llm.decontamination import _BREAK, _LOWER
from outletlens.llm.substring_dedup import pieces, run_hashes

# Usual notices of licence families.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License version 3",
             "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache": ["licensed under the Apache License, Version 2.0",
               "you may not use this file except in compliance with the License",
               "distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "BSD": ["released under the BSD License", "use of this source code is governed by a BSD-style license",
            "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC0": ["dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication", "licensed under CC0 1.0"],
    "CC-BY": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL": ["licensed under the GNU General Public License, version 3",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "ISC": ["released under the ISC License",
            "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["licensed under the GNU Lesser General Public License version 2.1",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["released under the MIT License",
            "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0"],
    "Proprietary": ["all rights reserved", "proprietary and confidential, unauthorized copying of this file is strictly prohibited"],
}
# Short names of the families, as in identifiers and one-line statements.
NAMES = {"AGPL": ["AGPL", "AGPLv3", "AGPL-3.0"], "Apache": ["Apache", "Apache-2.0", "Apache 2.0"], "BSD": ["BSD", "BSD-3-Clause", "BSD-2-Clause"],
         "CC0": ["CC0", "CC0-1.0"], "CC-BY": ["CC-BY-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"],
         "GPL": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"], "ISC": ["ISC"], "LGPL": ["LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0"], "MIT": ["MIT"],
         "MPL": ["MPL", "MPL-2.0"]}
STATEMENTS = ("SPDX-License-Identifier: {}", "{} License", "License: {}", "Licensed under {}", "Released under {}", "Licensed under the {} License")
for _family, _names in NAMES.items():
    TEMPLATES[_family] += [s.format(n) for n in _names for s in STATEMENTS]
# Statements of rights of no family above; {} is any word.
UNKNOWN = ["licensed under the {} {} license", "this work is distributed under the {} licence", "released under the terms of the {} public license",
           "Copyright (c) 2020 {} {}", "Copyright 2019 {} {}", "Copyright (C) 1998, 2003 {}", "(c) 2015 {} {}. All rights reserved",
           "License: {}", "SPDX-License-Identifier: {}", "see the LICENSE file for the terms of use of this {}",
           "use of this {} is subject to the {} license agreement", "permission to copy and use this {} is granted under the {} license"]
# Sentences about licences that grant none.
OTHER = ["the driver must carry a valid license at all times", "the city issued a new license to the bar on the corner",
         "read the license before you install the program", "public rights are discussed in general terms",
         "a fishing license is required in most states", "the software is free to try for a month",
         "the general public was invited to the opening", "conditions of any kind are possible in the mountains",
         "under the terms of the contract the price is fixed", "the foundation published a report on free speech",
         "the version of the story that we know", "copies of the book are available in the library"]
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_PAIR = 0xE7037ED1A0B428DB
COARSE = 20  # leading bits of an n-gram's hash that are looked up first


def grams(raw: np.ndarray, off: np.ndarray):
    """Paragraph of every word n-gram (n = 1 to 3; paragraphs end at newlines), its hash and n; start
    byte and length of the paragraphs, and the first paragraph of each text."""
    low = _LOWER[raw]
    ps, pe, pf = spans(low, off, _NEWLINE)
    edges = np.append(ps, len(low))
    start, end, _ = spans(low, edges if len(ps) and ps[0] == 0 else np.concatenate([[0], edges]), _BREAK)
    of = np.searchsorted(ps, start, "right") - 1
    h = span_hashes(low, start, end)
    out = [(of, h, 1)]
    for n in (2, 3):
        if len(h) >= n:
            same = of[n - 1:] == of[:len(of) - n + 1]
            out.append((of[:len(of) - n + 1][same], run_hashes(h, n, _PAIR)[same], n))
    return out, ps, pe, pf


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Vocabulary:
    """Places of n-gram hashes among those seen in training; a table of their leading bits spares most searches."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.there = np.zeros(1 << COARSE, bool)
        self.there[(self.hashes >> np.uint64(64 - COARSE)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of ``h`` that are known, and their places."""
        at = np.flatnonzero(self.there[(h >> np.uint64(64 - COARSE)).astype(np.int64)])
        place = np.searchsorted(self.hashes, h[at])
        known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == h[at]
        return at[known], place[known]


def paragraph_features(found, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph and place of every known n-gram, each once a paragraph however often it is repeated."""
    of, place = [], []
    for paragraph, h, _ in found:
        at, where = vocabulary.find(h)
        of.append(paragraph[at])
        place.append(where)
    size = max(len(vocabulary.hashes), 1)
    return np.divmod(np.unique(np.concatenate(of) * size + np.concatenate(place)), size)


def one_line(text: str) -> np.ndarray:
    return np.frombuffer(text.replace("\n", " ").encode() or b" ", np.uint8)


class Model:
    """Multinomial logistic regression over the word n-grams seen in training, with an intercept; class 0 is no
    licence. Unseen n-grams weigh nothing."""

    def __init__(self, texts: list[str], classes: np.ndarray, n_classes: int, epochs: int, seed: int):
        rng = np.random.default_rng(seed)
        each = [one_line(t) for t in texts]
        found = [grams(raw, np.array([0, len(raw)]))[0] for raw in each]
        self.vocabulary = Vocabulary(np.concatenate([h for one in found for _, h, _ in one]))
        self.w = np.zeros((len(self.vocabulary.hashes), n_classes), np.float32)
        self.bias = np.zeros(n_classes)
        self.temperature, self.held_out_accuracy = 1.0, float("nan")
        places = [paragraph_features(one, self.vocabulary)[1] for one in found]
        size = np.array([len(p) for p in places])
        fold = rng.random(len(texts)) < 0.2
        grad2 = np.full(self.w.shape, 1e-3, np.float32)
        bias2 = np.full(n_classes, 1e-3)

        def z(batch):
            of = np.repeat(np.arange(len(batch)), size[batch])
            place = np.concatenate([places[i] for i in batch]) if len(batch) else np.zeros(0, np.int64)
            return of, place, self.logits(of, place, len(batch))

        for _ in range(epochs):
            train = rng.permutation(np.flatnonzero(~fold))
            for batch in np.array_split(train, max(1, len(train) // 64)):
                of, place, logits = z(batch)
                p = softmax(logits)
                p[np.arange(len(batch)), classes[batch]] -= 1
                hit, back = np.unique(place, return_inverse=True)
                g = np.zeros((len(hit), n_classes), np.float32)
                np.add.at(g, back, (p / np.sqrt(np.maximum(size[batch], 1))[:, None]).astype(np.float32)[of])
                grad2[hit] += g ** 2
                self.w[hit] -= 0.3 * g / np.sqrt(grad2[hit])
                bias2 += p.sum(axis=0) ** 2
                self.bias -= 0.1 * p.sum(axis=0) / np.sqrt(bias2)
        held = np.flatnonzero(fold)
        if len(held):
            logits = z(held)[2]
            # one temperature for all classes, by held-out likelihood
            loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), classes[held]], 1e-12)).mean()
            self.temperature = min(np.geomspace(0.25, 8, 25), key=loss)
            self.held_out_accuracy = float((logits.argmax(axis=1) == classes[held]).mean())

    def logits(self, of: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` paragraphs with the n-grams at ``place``, the i-th in paragraph ``of[i]`` (ascending)."""
        out = np.zeros((n, self.w.shape[1]))
        for lo in range(0, len(of), 1 << 16):  # so that the rows of weights stay in cache
            part = of[lo:lo + (1 << 16)]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            out[part[first]] += np.add.reduceat(self.w[place[lo:lo + (1 << 16)]], first, axis=0)
        return out / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))[:, None] + self.bias

    def probabilities(self, of: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        return softmax(self.logits(of, place, n) / self.temperature)


def training_texts(background: list[str], copies: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Reworded notices of every family (words dropped, cases changed, text around them), statements of no family
    (the last class), sentences that only speak of licences, and background lines."""
    rng = np.random.default_rng(seed)
    pool = [w for t in background for w in t.split()] or ["the"]
    word = lambda: pool[rng.integers(0, len(pool))]
    some = lambda: " ".join(word() for _ in range(rng.integers(0, 12)))
    texts, classes = [], []
    for k, notices in enumerate([OTHER, *TEMPLATES.values(), UNKNOWN]):
        for notice in notices:
            for _ in range(copies if len(notices) < 20 else max(8, copies // 5)):
                filled = "".join(part + (word() if i < notice.count("{}") else "") for i, part in enumerate(notice.split("{}")))
                words = [w for w in filled.split() if len(filled.split()) < 6 or rng.random() > 0.08]
                text = " ".join(words)
                text = text.upper() if rng.random() < 0.1 else text.lower() if rng.random() < 0.3 else text
                texts.append(f"{some()} {text} {some()}" if rng.random() < 0.8 else text)
                classes.append(k)
    # a word of a notice alone says nothing
    alone = sorted({w for notices in (*TEMPLATES.values(), UNKNOWN) for n in notices for w in n.split()} - {"{}"})
    for w in alone * max(1, copies // 6):
        few = [word() for _ in range(rng.integers(0, 5))]
        few.insert(int(rng.integers(0, len(few) + 1)), w)
        texts.append(" ".join(few).capitalize() if rng.random() < 0.5 else " ".join(few))
        classes.append(0)
    # nor do the words that stand around
    texts += [" ".join(word() for _ in range(rng.integers(1, 60))) for _ in range(20 * copies)]
    classes += [0] * (20 * copies)
    return texts + background, np.array(classes + [0] * len(background))


def background_lines(rows: DataFrame, fit_lines: int, seed: int) -> list[str]:
    """About ``fit_lines`` distinct lines, drawn by hash from all lines of all texts; of a line over 2000
    characters that many from a place given by the hash."""
    n = rows.agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    lines = rows.select(F.explode(F.split("text", "\n")).alias("t")).filter(F.col("t").rlike(r"\S"))
    h = F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1_000_003))
    drawn = lines.filter(h / 1_000_003 < fit_lines / n).select(
        F.substring("t", (F.lit(1) + F.pmod(h, F.greatest(F.char_length("t") - 2000, F.lit(1)))).cast("int"), F.lit(2000)).alias("t")).distinct()
    return sorted(r["t"] for r in drawn.limit(2 * fit_lines).collect())


def find_licenses(docs: DataFrame, fit_lines: int = 4000, copies: int = 60, confirm: float = 0.6, sure: float = 0.5,
                  seed: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence paragraphs of all documents.

    The classifier is fitted on the driver on reworded notices, on statements of rights of no known family, and on about ``fit_lines``
    lines of the documents without two word pairs of any notice (a documented bound; never twice that); its probabilities
    are calibrated on a held-out fifth. Every line of every text is classified. Lines likelier a licence than not
    that follow each other without a blank line are one paragraph, which is classified again as a whole; where a line before or behind it
    (a wrapped notice) raises its agreement with a notice, it belongs to it. A prediction of a family
    with at least ``sure`` stands if the paragraph holds ``confirm`` of the word pairs of one of the family's
    notices; else the paragraph is ``unknown``.

    One row per licence paragraph: ``doc_id, line`` (number from 0 among the lines that are not
    empty), ``lines`` (how many), ``start`` (byte), ``family, probability`` (of the family, or of any licence where unknown), ``overlap``. Null and empty texts
    have none; a text that is one long line has one paragraph at most; null ids and repeated rows
    are reported each; other columns are not read; an empty table gives no rows."""
    names = list(TEMPLATES)
    pairs = {f: [np.unique(grams(one_line(t), np.array([0, len(one_line(t))]))[0][1][1]) for t in ts] for f, ts in TEMPLATES.items()}
    known = Vocabulary(np.concatenate([p for ps in pairs.values() for p in ps]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def pairs_of(raw: np.ndarray) -> np.ndarray:
        found = grams(raw, np.array([0, len(raw)]))[0]
        return found[1][1] if len(found) > 1 else np.zeros(0, np.uint64)

    background = [t for t in background_lines(rows, fit_lines, seed) if len(known.find(pairs_of(one_line(t)))[0]) < 2]
    model = Model(*training_texts(background, copies, seed), len(names) + 2, 4, seed)

    def judged(piece: bytes) -> tuple[float, float, str, float]:
        """Agreement with the best family's notices, its probability, the family, and the probability of any."""
        raw = np.frombuffer(piece.replace(b"\n", b" "), np.uint8)
        found = grams(raw, np.array([0, len(raw)]))[0]
        p = model.probabilities(*paragraph_features(found, model.vocabulary), 1)[0]
        best = int(p[1:-1].argmax())
        mine = np.unique(found[1][1]) if len(found) > 1 else np.zeros(0, np.uint64)
        return max(float(np.isin(t, mine).mean()) for t in pairs[names[best]]), float(p[best + 1]), names[best], float(1 - p[0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in pieces(batch, "text"):
                found, ps, pe, pf = grams(raw, off)
                if not len(ps):
                    continue
                p = model.probabilities(*paragraph_features(found, model.vocabulary), len(ps))
                hit = np.flatnonzero(p[:, 0] < sure)
                data, text = raw.tobytes(), np.searchsorted(pf, np.arange(len(ps)), "right") - 1
                # the next line of the same text, with one newline between
                joined = lambda k: k + 1 < len(ps) and text[k] == text[k + 1] and data[pe[k]:ps[k + 1]].count(b"\n") < 2
                out, at = [], 0
                while at < len(hit):
                    a = b = int(hit[at])
                    while at + 1 < len(hit) and hit[at + 1] == b + 1 and joined(b):
                        at, b = at + 1, b + 1
                    at += 1
                    before = [a - 1, a] if a and joined(a - 1) else [a]
                    behind = [b, b + 1] if joined(b) else [b]
                    spans_ = sorted(((x, y) for x in before for y in behind), key=lambda s, a=a, b=b: s[1] - s[0])
                    tried = [(judged(data[ps[x]:pe[y]]), x, y) for x, y in spans_]
                    (overlap, chance, family, any_), x, y = max(tried, key=lambda r: (r[0][1] >= sure and r[0][0] >= confirm, r[0][0]))
                    if not (chance >= sure and overlap >= confirm):
                        (overlap, chance, family, any_), x, y = tried[0]
                        family, chance = "unknown", any_
                    t = int(text[x])
                    out.append((t, x - int(pf[t]), y - x + 1, int(ps[x] - off[t]), family, chance, overlap))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))],
                        ["doc_id", "line", "lines", "start", "family", "probability", "overlap"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, line long, lines long, start long, family string, probability double, overlap double")
