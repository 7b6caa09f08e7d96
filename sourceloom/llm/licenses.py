"""Licence scans by a trained paragraph classifier.

A paragraph is a run of lines with words, so a notice may be wrapped at any place.
Every paragraph is read in overlapping windows of several widths, and by its lines,
each scored by a sparse logistic regression for each licence family over hashed
n-grams of one to three words; so words around a notice don't hide it. Only a
document's text is read. The scores are calibrated on held-out paragraphs: a family
is predicted where its probability passes the threshold that keeps PRECISION there.

A prediction is confirmed by template comparison: some stretch of its paragraph,
of at most SPREAD times the words of one of the family's templates, must hold enough of
the template's word pairs, and score as that family by itself, by its lines or with
MARGIN words on each side; of overlapping stretches the closest template's stays.
A further output tells licence-like words, of known families or not, from all else. A
paragraph with a window over its threshold, which at most STRAY of held-out
paragraphs without licences pass, in which nothing is confirmed is of the unknown class:
licence-like, of no known family.

The classifier is fitted in numpy on TRAIN_ROWS made-up paragraphs (templates cut,
reworded and set among other words, and near misses: words of licences out of order,
mentions of other licences) and on NEGATIVES stretches of the documents themselves,
drawn at random, but for those that hold a good part of a template.

Defined results: a document without confirmed notices has the family list ''
and confidence 0; a null or empty text has no paragraphs, licensed or unknown; repeated rows are
scanned again; a null doc_id stays null; an empty table gives no rows; texts of
any length are scanned whole; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, with_bytes
from .decontaminate import _FOLD, word_ids
from .neardup import mix

# fixed values: short notices of licence families, as their stewards word them
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Licensed under the GNU Affero General Public License, version 3"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "Licensed under the BSD 3-Clause License", "Released under the BSD License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal, dedicated to the public domain"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU General Public License version 2 or later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "Licensed under the MIT License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License Version 2.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
FAMILIES = list(TEMPLATES)
#: outputs of the classifier: the families, and whether a text is licence-like
OUTPUTS, LIKE = len(FAMILIES) + 1, len(FAMILIES)
BITS, NGRAM = 16, 3
TRAIN_ROWS, PRECISION, STRAY = 6000, 0.995, 0.002
#: stretches of documents to learn from, and their words
NEGATIVES, NEGATIVE_WORDS = 1500, 48
#: words whose windows are scored at a time
PART_WORDS = 1 << 15
#: windows' widths in words; each starts at every third of its width
WIDTHS = (6, 12, 24, 48)
#: share of a template's word pairs that confirms a prediction
CONFIRM = 0.6
#: a notice's words, in template lengths; words scored on each side of it
SPREAD, MARGIN = 2, 12
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]


def features(words: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, bucket) of each n-gram; ``lines`` tells each word's line, in order."""
    owners, buckets = [], []
    key = np.zeros(len(words), np.uint64)
    for n in range(1, NGRAM + 1):
        size = len(words) - n + 1
        if size < 1:
            break
        key = key[:size] * _STEP + words[n - 1 :]
        whole = lines[:size] == lines[n - 1 :]
        owners.append(lines[:size][whole])
        buckets.append((mix(key[whole] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(owners), np.concatenate(buckets)) if owners else (lines[:0], np.zeros(0, np.int64))


def _made(rng: random.Random) -> tuple[str, int]:
    """A paragraph and its family's number (-1: licence-like, of none; -2: nothing of the kind)."""
    word = lambda: "".join(rng.choice("aeiounrstldmhc") for _ in range(rng.randint(2, 10)))
    filler = lambda k: [word() for _ in range(rng.randint(0, k))]
    family = rng.randrange(len(FAMILIES))
    words = rng.choice(TEMPLATES[FAMILIES[family]]).split()
    draw = rng.random()
    if draw < 0.5:
        for k in range(len(words)):  # a few words changed, put in or left out
            if rng.random() < 0.04:
                words[k] = rng.choice(["", word(), words[k].upper(), words[k] + " " + word()])
        return " ".join(filler(12) + words + filler(12)), family
    if draw < 0.65:  # licences' words, out of order
        pool = [w for t in TEMPLATES.values() for s in t for w in s.split()]
        return " ".join(rng.choice(pool) for _ in range(rng.randint(3, 25))), -1
    if draw < 0.75:  # too little of a notice
        at = rng.randrange(len(words))
        return " ".join(filler(12) + words[at : at + 2] + filler(12)), -2
    if draw < 0.80:  # other licences
        form = rng.choice(["Licensed under the {} License", "Released under the {} License, version {}", "This work is licensed under the {} {} License", "distributed under the terms of the {} License"])
        return " ".join([*filler(12), form.format(word().capitalize(), word()), *filler(12)]), -1
    if draw < 0.84:  # talk of licences
        return rng.choice(["this work is licensed to {}", "driver license of {} {}", "see the {} license"]).format(word(), word()), -2
    return " ".join(filler(60) + [word()]), -2


class Classifier:
    def __init__(self, others: list[bytes] = ()) -> None:
        """``others``: stretches of texts; those with a good part of a template are left out."""
        rng = random.Random(23)
        self.templates = [(f, len(word_ids(t.encode())), np.unique(_pairs(word_ids(t.encode())))) for f, name in enumerate(FAMILIES) for t in TEMPLATES[name]]
        self.least = [next(k for k in range(len(pairs) + 1) if k / len(pairs) >= CONFIRM) for _, _, pairs in self.templates]
        self.known = np.unique(np.concatenate([pairs for _, _, pairs in self.templates]))
        self.holders: list[list[int]] = [[t for t, (_, _, pairs) in enumerate(self.templates) if k in pairs] for k in self.known]
        made = [_made(rng) for _ in range(TRAIN_ROWS)]
        made += [(t.decode("utf-8", "replace"), -2) for t in others if not self._partly(word_ids(t))]
        ids = [word_ids(t.encode()) for t, _ in made]
        lines, buckets = features(np.concatenate(ids), np.repeat(np.arange(len(made)), [len(x) for x in ids]))
        y = np.array([f for _, f in made])
        fit = np.arange(len(made)) % 3 > 0
        used, at = np.unique(buckets, return_inverse=True)
        weights, bias = np.zeros((len(used), OUTPUTS)), np.full(OUTPUTS, -3.0)
        seen_w, seen_b = np.full(weights.shape, 1e-6), np.full(bias.shape, 1e-6)
        target = np.concatenate([y[:, None] == np.arange(LIKE), y[:, None] >= -1], axis=1)
        on = fit[lines]
        rows, cols = lines[on], at[on]
        length = np.sqrt(np.maximum(np.bincount(lines, minlength=len(made)), 1))
        for _ in range(60):  # full-batch steps, scaled by past gradients
            error = (1 / (1 + np.exp(-self._sums(weights, bias, rows, cols, len(made), length))) - target) * fit[:, None]
            grad = np.zeros_like(weights)
            np.add.at(grad, cols, (error / length[:, None])[rows])
            grad += 0.02 * weights
            seen_w += grad**2
            seen_b += error.sum(axis=0) ** 2
            weights -= 0.5 * grad / np.sqrt(seen_w)
            bias -= 0.5 * error.sum(axis=0) / np.sqrt(seen_b)
        self.weights = np.zeros((1 << BITS, OUTPUTS), np.float32)
        self.weights[used] = weights
        self.bias = bias.astype(np.float32)
        scores = self._sums(weights, bias, lines, at, len(made), length)[~fit]
        # the calibrated unknown class: below its threshold, a family is not predicted
        self.thresholds = np.zeros(len(FAMILIES))
        for f in range(len(FAMILIES)):
            best = np.flatnonzero(scores[:, :LIKE].argmax(axis=1) == f)
            order = best[np.argsort(-scores[best, f], kind="stable")]
            right = np.cumsum(y[~fit][order] == f) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= PRECISION)
            self.thresholds[f] = scores[order[good[-1]], f] if len(good) else np.inf
        # by the best of a paragraph's windows, as they are judged
        none = lambda x: np.zeros(len(x), np.int64)
        clean = np.sort([self.windows(x, none(x), none(x))[2][:, LIKE].max() for x, kind, learned in zip(ids, y, fit) if kind == -2 and not learned and len(x)])
        self.licence_like = float(max(clean[-1 - int(STRAY * len(clean))], 0.0)) if len(clean) else 0.0

    def _partly(self, words: np.ndarray) -> bool:
        """Whether half of what confirms a template is there."""
        seen = defaultdict(int)
        for k in np.unique(self._hits(words)[1]).tolist() if len(words) > 1 else ():
            for t in self.holders[k]:
                seen[t] += 1
        return any(2 * n >= self.least[t] for t, n in seen.items())

    @staticmethod
    def _sums(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, length: np.ndarray) -> np.ndarray:
        out = np.empty((n, weights.shape[1]))
        for f in range(weights.shape[1]):
            out[:, f] = np.bincount(rows, weights[cols, f], n)
        return out / length[:, None] + bias

    def scores(self, units: list[np.ndarray]) -> np.ndarray:
        """Units x outputs."""
        lines, buckets = features(np.concatenate(units), np.repeat(np.arange(len(units)), [len(x) for x in units]))
        order = np.argsort(lines, kind="stable")
        counts = np.bincount(lines, minlength=len(units))
        return np.add.reduceat(self.weights[buckets[order]], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None] + self.bias

    def _hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where template pairs are, and which."""
        pairs = _pairs(words)
        which = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        at = np.flatnonzero(self.known[which] == pairs)
        return at, which[at]

    def _possible(self, which: np.ndarray) -> set[int]:
        """Templates with enough pairs among these."""
        seen = defaultdict(int)
        for k in np.unique(which).tolist():
            for t in self.holders[k]:
                seen[t] += 1
        return {t for t, n in seen.items() if n >= self.least[t]}

    def windows(self, words: np.ndarray, paragraph: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, scores) of the windows of all paragraphs; words are given with their paragraph and line."""
        n = len(words)
        edges = np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1]))
        first, last = np.repeat(edges, np.diff(np.append(edges, n))), np.repeat(np.append(edges[1:], n), np.diff(np.append(edges, n)))
        own = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        begins, ends = [own], [np.minimum(np.append(own[1:], n), own + 2 * WIDTHS[-1])]
        for width in WIDTHS:
            start = np.arange(0, n, width // 3)
            for at in (start, edges, np.maximum(np.append(edges[1:], n) - width, edges)):
                at = np.unique(at)
                begins.append(at)
                ends.append(np.minimum(at + width, last[at]))
        begin, end = np.unique(np.stack([np.concatenate(begins), np.concatenate(ends)], axis=1), axis=0).T
        total, count = np.zeros((len(begin), OUTPUTS)), np.zeros(len(begin))
        key = np.zeros(n, np.uint64)
        for size in range(1, NGRAM + 1):
            m = n - size + 1
            if m < 1:
                break
            key = key[:m] * _STEP + words[size - 1 :]
            sums = np.zeros((m + 1, OUTPUTS))
            np.cumsum(self.weights[(mix(key + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64)], axis=0, out=sums[1:])
            start = np.minimum(begin, m)
            stop = np.maximum(end - size + 1, start)  # n-grams that lie whole inside
            total += sums[stop] - sums[start]
            count += stop - start
        return begin, end, total / np.sqrt(np.maximum(count, 1))[:, None] + self.bias

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Paragraphs of a text, and (paragraph, family, probability, template share) of each confirmed notice."""
        return self.scan_all(raw)[:2]

    def scan_all(self, raw: bytes) -> tuple[int, list[tuple[int, int, float, float]], list[int]]:
        """The same, and the paragraphs of the unknown class."""
        paragraphs = sum(1 for x in re.split(rb"\n[ \n]*\n", raw.translate(_LINES)) if x.strip())
        ids = [word_ids(x) for x in raw.split(b"\n")]
        sizes = np.array([len(x) for x in ids])
        if not sizes.sum():
            return paragraphs, [], []
        words, line = np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes)
        paragraph = (np.cumsum((sizes > 0) & (np.append(0, sizes[:-1]) == 0)) - 1)[line]
        proposed: dict[int, set[int]] = defaultdict(set)
        like: set[int] = set()
        for low, high in _parts(paragraph):
            begin, _, scores = self.windows(words[low:high], paragraph[low:high], line[low:high])
            top = scores[:, :LIKE].argmax(axis=1)
            best = scores[np.arange(len(top)), top]
            for k in np.flatnonzero(best >= self.thresholds[top]).tolist():
                proposed[int(paragraph[low + begin[k]])].add(int(top[k]))
            like.update(paragraph[low + begin[scores[:, LIKE] >= self.licence_like]].tolist())
        found = []
        for number, families in proposed.items():
            low, high = np.searchsorted(paragraph, (number, number + 1))
            found += self._confirmed(families, words[low:high], line[low:high], int(low))
        kept = sorted(_apart(found), key=lambda x: x[2])
        notices = [(int(paragraph[begin]), family, p, -share) for _, _, begin, _, family, p, share in kept]
        return paragraphs, notices, sorted(like - {n[0] for n in notices})

    def _confirmed(self, families: set[int], words: np.ndarray, line: np.ndarray, offset: int) -> list[tuple]:
        """Stretches of a paragraph, which begins at ``offset``, that hold a template of a predicted family and score as it."""
        at, which = self._hits(words)
        possible = {t for t in self._possible(which) if self.templates[t][0] in families}
        places = defaultdict(list)
        for x, k in zip(at.tolist(), which.tolist()):
            for t in self.holders[k]:
                if t in possible:
                    places[t].append((x, k))
        found = []
        for t, hits in places.items():
            family, _, pairs = self.templates[t]
            near, by_line = self._spans(t, hits, line)
            for whole, (n, size, begin, end) in [(False, x) for x in _apart(near)] + [(True, x) for x in by_line]:
                first, last = np.searchsorted(line, (line[begin], line[end - 1] + 1))
                scores = self.scores([words[first:last], words[begin:end], words[max(0, begin - MARGIN) : end + MARGIN]])
                top = scores[(scores[:, :LIKE].argmax(axis=1) == family) & (scores[:, family] >= self.thresholds[family]), family]
                if len(top):
                    found.append(((whole, n / len(pairs)), size, offset + begin, offset + end, family, float(1 / (1 + np.exp(-top.max()))), n / len(pairs)))
        return found

    def _spans(self, t: int, hits: list[tuple[int, int]], line: np.ndarray) -> tuple[list[tuple], list[tuple]]:
        """(-pairs, words, begin, end) where a template has enough pairs, from each of its hits and by line."""
        reach = SPREAD * self.templates[t][1]
        near, by_line, lines = [], [], defaultdict(list)
        for a, (begin, k) in enumerate(hits):
            if line[begin] == line[begin + 1]:
                lines[int(line[begin])].append((begin, k))
            seen: set[int] = set()
            end = begin
            for x, other in hits[a : a + reach]:
                if x + 2 - begin > reach:
                    break
                if other not in seen:
                    seen.add(other)
                    end = x + 2
            if len(seen) >= self.least[t]:
                near.append((-len(seen), end - begin, begin, end))
        for own in lines.values():
            if (n := len({k for _, k in own})) >= self.least[t]:
                by_line.append((-n, own[-1][0] + 2 - own[0][0], own[0][0], own[-1][0] + 2))
        return near, by_line


def _apart(spans: list[tuple]) -> list[tuple]:
    """Of overlapping (rank, words, begin, end, ...) the first by rank, then the shortest."""
    kept, ranges = [], []
    for span in sorted(spans):
        begin, end = span[2:4]
        k = bisect.bisect(ranges, (begin, end))
        if (k and ranges[k - 1][1] > begin) or (k < len(ranges) and ranges[k][0] < end):
            continue
        ranges.insert(k, (begin, end))
        kept.append(span)
    return kept


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each two words in a row."""
    return mix(words[:-1] * _STEP + words[1:])


def _parts(paragraph: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PART_WORDS words; a longer paragraph is one of its own, in ranges that overlap by the widest window."""
    n, low = len(paragraph), 0
    while low < n:
        high = min(low + PART_WORDS, n)
        if high < n:
            cut = int(np.searchsorted(paragraph, paragraph[high]))
            high = cut if cut > low else high
        yield low, high
        low = high if high == n or paragraph[high] != paragraph[high - 1] else high - 2 * WIDTHS[-1]


_model: list[Classifier] = []


def classifier() -> Classifier:
    if not _model:
        _model.append(Classifier())
    return _model[0]


def sampled_stretches(docs: DataFrame, most: int = NEGATIVES) -> list[bytes]:
    """A stretch of each of about ``most`` documents, from a random place; at most NEGATIVE_WORDS words each."""
    rows = max(1, docs.count())

    def cut(chunks: Iterator[list[list]]) -> Iterator[dict]:
        rng = random.Random(5)
        for (raws,) in chunks:
            words = [r.split() for r in raws]
            starts = [rng.randrange(max(1, len(w) - NEGATIVE_WORDS + 1)) for w in words]
            yield {"stretch": [b" ".join(w[k : k + NEGATIVE_WORDS])[: 32 * NEGATIVE_WORDS] for w, k in zip(words, starts)]}

    sample = with_bytes(docs).select("raw").sample(False, min(1.0, most / rows), 19)
    return sorted(bytes(r.stretch) for r in map_rows(sample, ["raw"], cut, "stretch binary").collect())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, comma-joined), confidence, paragraphs (of each notice found), n_unknown and unknown (paragraphs of the unknown class)."""
    held = docs.sparkSession.sparkContext.broadcast(Classifier(sampled_stretches(docs)))

    def run(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for doc_ids, raws in chunks:
            out: dict[str, list] = {"doc_id": doc_ids, "n_paragraphs": [], "n_licensed": [], "families": [], "confidence": [], "paragraphs": [], "n_unknown": [], "unknown": []}
            for raw in raws:
                n, found, unknown = held.value.scan_all(raw)
                out["n_paragraphs"].append(n)
                out["n_licensed"].append(len(found))
                out["families"].append(",".join(sorted({FAMILIES[f] for _, f, _, _ in found})))
                out["confidence"].append(max((p for _, _, p, _ in found), default=0.0))
                out["paragraphs"].append([{"paragraph": k, "family": FAMILIES[f], "probability": p, "template_share": s} for k, f, p, s in found])
                out["n_unknown"].append(len(unknown))
                out["unknown"].append(unknown)
            yield out

    return map_rows(with_bytes(docs), ["doc_id", "raw"], run, "doc_id long, n_paragraphs long, n_licensed long, families string, confidence double, paragraphs array<struct<paragraph:int,family:string,probability:double,template_share:double>>, n_unknown long, unknown array<int>")
