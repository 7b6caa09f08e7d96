"""Toxicity by a bidirectional gated recurrent network over words and characters.

Each word enters as a learned word vector, the mean of learned vectors of its
character n-grams (with marks at the word's ends), and four evidence values: how
much oftener the word, and the most telling of its n-grams, occur in documents
of one class than of the other (log ratio and signed root of the likelihood
ratio statistic). Only words and n-grams of at least ``SEEN`` training documents
(groups of copies count once) have vectors and evidence, so rare spellings cannot be learned by heart, and
while training a document's evidence comes from documents of other folds. Two
gated recurrent passes read a window of words, attention pools their states, and
a logistic unit scores the window. A text is scored by overlapping windows of
``WINDOW`` words at every ``STRIDE``-th word and at its end, so each run of up to
``WINDOW - STRIDE`` words lies whole in one; its worst window counts.

The network is trained in numpy, in one task on an executor, on at most
``TRAIN_DOCS`` labelled documents, half of each class, taken in the order of a
hash of their ids; of each at most ``TRAIN_WINDOWS`` windows, evenly spread, are
used. A quarter of them is first held back: the number of training rounds and the
logit's calibration (to the share of toxic rows among all labels) come from it,
then all are learned. Only the weights leave the task. Texts never leave the
executors, and only text enters a score.

Defined results: a text without words, or null, scores 0; repeated rows score
alike; rows with a null doc_id are in the training fold but never labelled;
labels that are null, or differ for one doc_id, are left out; without labels of
both classes every score is the share of toxic ones (0 without any); an empty
table gives no rows; texts of any length are scored whole; other columns are not
looked at.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_rows, with_bytes
from .neardup import fold, mix, word_hashes

#: the sample learned from: documents, windows of one
TRAIN_DOCS, TRAIN_WINDOWS = 2400, 96
WINDOW, STRIDE = 48, 24
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
GRAMS = (3, 4, 5)
#: groups of copies that a word or n-gram must occur in, and folds for its evidence while training
SEEN, FOLDS = 3, 8
#: evidence values of a word, and of its n-grams
EVIDENCE = 2
INPUT = 2 * WIDTH + 2 * EVIDENCE
#: training: rounds of steps, windows of a step, share of documents held back (one in)
ROUNDS, STEPS, BATCH, HELD_BACK = 8, 20, 128, 4
RATE, TABLE_RATE, DECAY = 0.01, 0.05, 1e-3
#: windows scored, and texts hashed, at a time
BLOCK, HASHED = 1024, 128
#: distinct words whose n-grams are made, n-grams numbered, and training windows scored, at a time
SPELLED, NUMBERED, WATCHED = 1 << 13, 1 << 19, 1 << 12
THRESHOLD = 0.3

_GRAM = 0x9E3779B97F4A7C15


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def spelled_out(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some words, by word, and how many each has; ``lengths`` count a space at either end."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(starts - 1, lengths)
    letters = codes[place].astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    grams, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for n in GRAMS:
        if len(letters) < n:
            continue
        size = len(letters) - n + 1
        key = np.full(size, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(_GRAM) + letters[k : k + size]
        whole = owner[:size] == owner[n - 1 :]
        grams.append(mix(key[whole]))
        owners.append(owner[:size][whole])
    of = np.concatenate(owners)
    return np.concatenate(grams)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(lengths))


class Words:
    """The distinct words of some folded texts, and the hashes of their character n-grams."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b" " + b" ".join(texts) + b" "
        # by parts, so that what hashing needs stays small beside the texts
        hashes = np.concatenate([word_hashes(b" ".join(texts[k : k + HASHED])) for k in range(0, max(len(texts), 1), HASHED)])
        self.hashes, first, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        codes = np.frombuffer(joined, np.uint8)
        edges = np.flatnonzero((codes[1:] == 32) != (codes[:-1] == 32)) + 1
        starts, ends = edges[::2][first], edges[1::2][first]
        del hashes, edges
        lengths = ends - starts + 2  # each word with a space at either end
        # by parts, as above
        parts = [spelled_out(codes, starts[k : k + SPELLED], lengths[k : k + SPELLED]) for k in range(0, len(lengths), SPELLED)]
        self.grams = np.concatenate([grams for grams, _ in parts] or [np.zeros(0, np.uint64)])  # by word, the shortest first
        self.counts = np.concatenate([counts for _, counts in parts] or [np.zeros(0, np.int64)])  # a one-letter word has one n-gram at least
        self.starts = np.cumsum(self.counts) - self.counts
        self.short = np.maximum(lengths - GRAMS[0] + 1, 1)  # how many are of the least length

    def gram_places(self, some: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``grams`` of the first n-grams (``each`` of them) of some words, and the word of each place."""
        owner = np.repeat(np.arange(len(some)), each)
        firsts = np.cumsum(each) - each
        return np.arange(len(owner)) + (self.starts[some] - firsts)[owner], owner


class Known:
    """Rows of known hashes; unknown ones get the last row, of zeros."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.none = keys, len(keys)
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slots = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.first).max()) if len(keys) else 0

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Keys are sorted, so those of one slot lie together: look at each place of the slot in turn."""
        out = np.full(len(hashes), self.none, np.int32)
        if not self.none:
            return out
        slot = (hashes >> self.shift).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < stop)
        for _ in range(self.depth):
            here = at[left]
            out[left] = np.where(self.keys[here] == hashes[left], here, out[left])
            at[left] += 1
            left = left[(at[left] < stop[left]) & (out[left] == self.none)]
        return out


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log ratio of smoothed shares and signed root of the likelihood ratio statistic, by numbers of documents."""
    n_toxic, n_clean = max(n_toxic, 1.0), max(n_clean, 1.0)
    ratio = np.log((toxic + 2) / (n_toxic + 4)) - np.log((clean * n_toxic / n_clean + 2) / (n_toxic + 4))
    both = toxic + clean
    total = n_toxic + n_clean
    part = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9)), 0)
    g = sum(part(n, e) for n, e in ((toxic, both * n_toxic / total), (clean, both * n_clean / total), (n_toxic - toxic, (total - both) * n_toxic / total), (n_clean - clean, (total - both) * n_clean / total)))
    root = np.sign(toxic * n_clean - clean * n_toxic) * np.sqrt(np.maximum(2 * g, 0))
    return np.stack([ratio, np.clip(root, -15, 15) / 4], axis=-1).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """Where the windows of ``n`` words begin; the last ends with the text."""
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW) if n > WINDOW else np.zeros(min(n, 1), np.int64)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and words of each window; the last window of a text ends with it."""
    docs, starts, sizes = [], [], []
    base = np.concatenate([[0], np.cumsum(counts)])
    for k, n in enumerate(counts):
        if n:
            inner = window_starts(n)
            docs.append(np.full(len(inner), k))
            starts.append(base[k] + inner)
            sizes.append(np.full(len(inner), min(n, WINDOW)))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(docs or none), np.concatenate(starts or none).astype(np.int64), np.concatenate(sizes or none)


def summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values of each row."""
    return np.stack([np.bincount(rows, column, size) for column in values.T], axis=1).astype(np.float32)


class Network:
    """Known words and n-grams, parameters, the forward pass and its gradient."""

    def __init__(self, words: np.ndarray = np.zeros(0, np.uint64), grams: np.ndarray = np.zeros(0, np.uint64), seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.known_words, self.known_grams = Known(words), Known(grams)
        self.word, self.gram = draw(len(words) + 1, WIDTH, scale=0.05), draw(len(grams) + 1, WIDTH, scale=0.1)
        self.word[-1] = self.gram[-1] = 0
        self.word_evidence, self.gram_evidence = np.zeros((len(words) + 1, EVIDENCE), np.float32), np.zeros((len(grams) + 1, EVIDENCE), np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.p = {}
        for d in "fb":
            self.p |= {f"w{d}": draw(INPUT, 3 * HIDDEN, scale=0.4), f"u{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(2 * HIDDEN, ATTENTION, scale=0.4), "v": draw(ATTENTION, scale=0.4), "o": draw(2 * HIDDEN, scale=0.4), "b": np.zeros(1, np.float32)}

    def packed(self) -> bytes:
        held = io.BytesIO()
        np.savez_compressed(held, words=self.known_words.keys, grams=self.known_grams.keys, word=self.word, gram=self.gram, word_evidence=self.word_evidence, gram_evidence=self.gram_evidence, calibration=np.array([self.scale, self.shift]), **{f"p_{k}": v for k, v in self.p.items()})
        return held.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> "Network":
        with np.load(io.BytesIO(blob)) as held:
            net = cls(held["words"], held["grams"])
            net.word, net.gram, net.word_evidence, net.gram_evidence = held["word"], held["gram"], held["word_evidence"], held["gram_evidence"]
            net.scale, net.shift = map(float, held["calibration"])
            net.p = {k: held[f"p_{k}"] for k in net.p}
        return net

    def vectors(self, words: Words) -> np.ndarray:
        """What each distinct word puts in."""
        if not len(words.hashes):
            return np.zeros((0, INPUT), np.float32)
        word, gram = self.known_words.rows(words.hashes), self.known_grams.rows(words.grams)
        places, owner = words.gram_places(np.arange(len(word)), words.short)
        sums = summed(owner, self.gram[gram[places]], len(word))
        return np.concatenate([self.word[word], sums / words.short[:, None], self.word_evidence[word], np.maximum.reduceat(self.gram_evidence[gram], words.starts, axis=0)], axis=1, dtype=np.float32)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each distinct word adds to the gates; the last row is for places after a text's end."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return {d: x @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def _pass(self, d: str, gates: np.ndarray, at: np.ndarray, live: np.ndarray | None, keep: list | None) -> np.ndarray:
        n, steps = at.shape
        h, u, size = np.zeros((n, HIDDEN), np.float32), self.p[f"u{d}"], HIDDEN
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, y = gates[at[:, t]], h @ u
            zr = np.tanh((x[:, : 2 * size] + y[:, : 2 * size]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[:, :size], zr[:, size:]
            c = np.tanh(x[:, 2 * size :] + r * y[:, 2 * size :])
            new = c + z * (h - c)
            if live is not None:
                new = np.where(live[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, y[:, 2 * size :]))
            h = new
            out[t] = h
        return out

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, live: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``at``: windows x steps of distinct words, ``live``: places before a text's end."""
        keeps = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        h = np.concatenate([self._pass(d, gates[d], at, live, keeps[d]) for d in "fb"], axis=2)
        q = np.tanh(h @ self.p["a"])
        e = q @ self.p["v"]
        if live is not None:
            e = np.where(live.T, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, h)
        if keep is not None:
            keep |= {"steps": keeps, "h": h, "q": q, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["b"][0]

    def backward(self, keep: dict, at: np.ndarray, live: np.ndarray, x: np.ndarray, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters and of the distinct words' vectors."""
        h, q, alpha, size = keep["h"], keep["q"], keep["alpha"], HIDDEN
        g = {"b": np.array([dlogit.sum()]), "o": dlogit @ keep["pooled"]}
        dpool = dlogit[:, None] * self.p["o"]
        dalpha = np.einsum("nh,tnh->tn", dpool, h)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", de, q)
        dq = de[:, :, None] * self.p["v"] * (1 - q * q)
        g["a"] = np.einsum("tnh,tna->ha", h, dq)
        dh_all = alpha[:, :, None] * dpool + dq @ self.p["a"].T
        full = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        dx = np.zeros_like(full)
        for d, part in (("f", slice(0, size)), ("b", slice(size, 2 * size))):
            u = self.p[f"u{d}"]
            gu, steps = np.zeros_like(u), np.empty((at.shape[1], at.shape[0], 3 * size), np.float32)
            dh = np.zeros(h.shape[1:2] + (size,), np.float32)
            for t, before, z, r, c, yc in reversed(keep["steps"][d]):
                dh = dh + dh_all[t][:, part]
                on = live[:, t, None]
                dnew = np.where(on, dh, 0)
                dz, dc = dnew * (before - c) * z * (1 - z), dnew * (1 - z) * (1 - c * c)
                dr = dc * yc * r * (1 - r)
                dy = np.concatenate([dz, dr, dc * r], axis=1)
                steps[t] = np.concatenate([dz, dr, dc], axis=1)
                gu += before.T @ dy
                dh = np.where(on, dnew * z + dy @ u.T, dh)
            dgates = summed(at.T.ravel(), steps.reshape(-1, 3 * size), len(full))
            dgates[-1] = 0
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = gu, full.T @ dgates, dgates.sum(axis=0)
            dx += dgates @ self.p[f"w{d}"].T
        return g, dx[:-1]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The worst window's logit of each text (minus infinity without words)."""
        folded = [fold(t) for t in texts]
        words = Words(folded)
        docs, starts, sizes = windows_of(np.array([len(t.split()) for t in folded], np.int64))
        logits = self.window_logits(self.vectors(words), words.index, starts, sizes)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, docs, logits)
        return worst

    def window_logits(self, x: np.ndarray, index: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        gates = self.project(x)
        logits = np.empty(len(starts), np.float32)
        for part, masked in ((np.flatnonzero(sizes == WINDOW), False), (np.flatnonzero(sizes < WINDOW), True)):
            if masked:
                part = part[np.argsort(sizes[part], kind="stable")]
            for k in range(0, len(part), BLOCK):
                some = part[k : k + BLOCK]
                at, live = self._places(index, starts[some], sizes[some], len(x))
                logits[some] = self.forward(gates, at, live if masked else None)
        return logits

    @staticmethod
    def _places(index: np.ndarray, starts: np.ndarray, sizes: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        steps = np.arange(sizes.max() if len(sizes) else 0)
        live = steps < sizes[:, None]
        return np.where(live, index[np.minimum(starts[:, None] + steps, max(len(index) - 1, 0))], none), live

    def probabilities(self, raws: list[bytes]) -> list[float]:
        logits = self.scale * self.score(raws) + self.shift
        return [1 / (1 + math.exp(-min(max(float(x), -700.0), 700.0))) if np.isfinite(x) else 0.0 for x in logits]


def copies(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The group of each of ``n`` texts: texts that agree in one of a few smallest hashes of word pairs are likely copies."""
    group = list(range(n))

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    pairs, of = words * np.uint64(_GRAM) + np.append(words[1:], np.uint64(0)), owner
    firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for salt in range(1, 5):
        seen: dict[int, int] = {}
        for k, key in zip(of[firsts].tolist(), np.minimum.reduceat(mix(pairs ^ mix(np.full(1, salt, np.uint64))), firsts).tolist()):
            group[top(k)] = top(seen.setdefault(key, k))
    return np.unique([top(k) for k in range(n)], return_inverse=True)[1]


class Sample:
    """Training windows: their words, and how many groups of copies in each class and fold hold each word and n-gram."""

    def __init__(self, windows: list[list[bytes]], labels: np.ndarray) -> None:
        flat = [w for held in windows for w in held]
        self.labels = labels
        self.docs = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        self.sizes = np.array([w.count(b" ") + 1 for w in flat], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = Words(flat)
        owner = np.repeat(self.docs, self.sizes)
        self.group = copies(self.words.hashes[self.words.index], owner, len(windows))
        self.folds = mix(self.group.astype(np.uint64) + np.uint64(1)).astype(np.int64) % FOLDS
        self.folds_at = self.folds[owner].astype(np.int8)
        parts = [self.words.grams[k : k + NUMBERED] for k in range(0, len(self.words.grams), NUMBERED)]
        self.gram_keys = np.unique(np.concatenate([np.unique(part) for part in parts] or [self.words.grams]))
        self.gram_of = np.concatenate([np.searchsorted(self.gram_keys, part).astype(np.int32) for part in parts] or [np.zeros(0, np.int32)])
        del parts, self.words.grams  # their numbers will do from here
        n_words, n_grams = len(self.words.hashes), len(self.gram_keys)
        self.by_word = np.zeros((FOLDS, 2, n_words), np.int32)
        self.by_gram = np.zeros((FOLDS, 2, n_grams), np.int32)
        for f in range(FOLDS):
            for y in (0, 1):
                here = (self.folds_at == f) & (labels[owner] == y)
                group, word = np.divmod(np.unique(self.group[owner[here]] * n_words + self.words.index[here]), max(n_words, 1))
                self.by_word[f, y] = np.bincount(word, minlength=n_words)
                places, at = self.words.gram_places(word, self.words.counts[word])
                held = np.unique(group[at] * n_grams + self.gram_of[places])
                self.by_gram[f, y] = np.bincount(held % max(n_grams, 1), minlength=n_grams)

    def numbers(self, folds: list[int]) -> tuple[float, float]:
        """Groups of toxic and of clean texts."""
        inside = np.isin(self.folds, folds)
        return tuple(float(len(np.unique(self.group[inside & (self.labels == y)]))) for y in (1, 0))


def train(sample: Sample, folds: list[int], rounds: int, watch: list[int] = (), seed: int = 5) -> tuple[Network, list[np.ndarray]]:
    """Fit on the documents of some folds: each round finds every text's worst window and learns the label there.

    For the documents of ``watch`` each round leaves their logits.
    """
    rng = np.random.default_rng(seed)
    words, labels = sample.words, sample.labels
    seen_word = sample.by_word[folds].sum(axis=(0, 1)) >= SEEN
    seen_gram = sample.by_gram[folds].sum(axis=(0, 1)) >= SEEN
    net = Network(words.hashes[seen_word], sample.gram_keys[seen_gram], seed)
    net.p["b"][0] = -1
    row = lambda seen: np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int32)
    blocks = [np.arange(k, min(k + SPELLED, len(words.hashes))) for k in range(0, len(words.hashes), SPELLED)]
    word_row, gram_row = row(seen_word), row(seen_gram)[sample.gram_of]

    def values(counts: np.ndarray, seen: np.ndarray, without: int) -> np.ndarray:
        some = [f for f in folds if f != without]
        n_toxic, n_clean = sample.numbers(some)
        clean, toxic = (counts[some, y][:, seen].sum(axis=0).astype(float) for y in (0, 1))
        return np.concatenate([evidence(toxic, clean, n_toxic, n_clean), np.zeros((1, EVIDENCE), np.float32)])

    net.word_evidence, net.gram_evidence = values(sample.by_word, seen_word, -1), values(sample.by_gram, seen_gram, -1)
    # a word counts once for each fold, with the evidence of the other folds
    at = np.where(np.isin(sample.folds_at, folds), sample.folds_at, FOLDS) * np.int64(len(words.hashes)) + words.index
    there = np.zeros((FOLDS + 1) * len(words.hashes), bool)
    there[at] = True
    typed, index = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - np.int32(1))[at]
    del at, there
    fold_of_typed, of = np.divmod(typed, max(len(words.hashes), 1))
    told = np.zeros((len(typed), 2 * EVIDENCE), np.float32)
    for f in np.unique(fold_of_typed):
        mine = np.flatnonzero(fold_of_typed == f)
        by_word, by_gram = (values(sample.by_word, seen_word, f), values(sample.by_gram, seen_gram, f)) if f < FOLDS else (net.word_evidence, net.gram_evidence)
        best = np.concatenate([np.maximum.reduceat(by_gram[gram_row[words.starts[b[0]] : words.starts[b[-1]] + words.counts[b[-1]]]], words.starts[b] - words.starts[b[0]], axis=0) for b in blocks])
        told[mine] = np.concatenate([by_word[word_row], best], axis=1)[of[mine]]

    def spelled(some: np.ndarray) -> np.ndarray:
        """What some distinct words put in, but for evidence."""
        places, owner = words.gram_places(some, words.short[some])
        sums = summed(owner, net.gram[gram_row[places]], len(some))
        return np.concatenate([net.word[word_row[some]], sums / words.short[some][:, None]], axis=1, dtype=np.float32)

    def logits_of(windows: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(windows), WATCHED):  # some windows' words at a time
            starts, sizes = sample.starts[windows[k : k + WATCHED]], sample.sizes[windows[k : k + WATCHED]]
            firsts = np.cumsum(sizes) - sizes
            inside, local = np.unique(index[np.arange(sizes.sum()) + np.repeat(starts - firsts, sizes)], return_inverse=True)
            x = np.concatenate([spelled(of[inside]), told[inside]], axis=1)
            out.append(net.window_logits(x, local, firsts, sizes))
        return np.concatenate(out)

    learned = np.flatnonzero(np.isin(sample.folds, folds)[sample.docs])
    watched = np.flatnonzero(np.isin(sample.folds, watch)[sample.docs])
    n_toxic, n_clean = sample.numbers(folds)
    weight = np.where(labels == 1, max(n_clean / max(n_toxic, 1), 1.0) ** 0.5, max(n_toxic / max(n_clean, 1), 1.0) ** 0.5)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    squares = {"word": np.full(len(net.word), 1e-4), "gram": np.full(len(net.gram), 1e-4)}
    none, step, history = len(typed), 0, []
    strength = np.maximum(told[:, 0], 0) + np.maximum(told[:, 2], 0)
    for turn in range(rounds):
        if turn:
            logits = logits_of(learned)
        else:  # nothing is known yet: the window with most evidence will do
            logits = np.add.reduceat(strength[index], sample.starts)[learned]
        pace = 1 - turn / (rounds + 1)
        order = learned[np.lexsort((-logits, sample.docs[learned]))]
        worst = order[np.append(True, sample.docs[order][1:] != sample.docs[order][:-1])]
        # beside it other windows of clean texts: those are clean everywhere, a toxic one is learned where it is worst
        other = order[labels[sample.docs[order]] == 0]
        chosen = np.concatenate([worst, rng.permutation(other)[: len(worst) // 2]])
        queue = np.concatenate([rng.permutation(chosen) for _ in range(-(-STEPS * BATCH // max(len(chosen), 1)))])
        for k in range(STEPS):
            some = queue[k * BATCH : (k + 1) * BATCH]
            at, live = net._places(index, sample.starts[some], sample.sizes[some], none)
            used, local = np.unique(at, return_inverse=True)
            inside = used[used < none]
            x = np.concatenate([spelled(of[inside]), told[inside]], axis=1)
            x[rng.random(len(x)) < 0.5, :WIDTH] = 0  # so that characters are learned too
            x[rng.random(len(x)) < 0.3, 2 * WIDTH : 2 * WIDTH + EVIDENCE] = 0
            keep: dict = {}
            local = local.reshape(at.shape)
            logit = net.forward(net.project(x), local, live, keep)
            doc = sample.docs[some]
            error = ((1 / (1 + np.exp(-logit)) - labels[doc]) * weight[doc] / len(some)).astype(np.float32)
            grads, dx = net.backward(keep, local, live, x, error)
            step += 1
            for name, grad in grads.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[name] -= (RATE * pace * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + DECAY * net.p[name])).astype(np.float32)
            _descend(net.word, squares["word"], pace, word_row[of[inside]], np.where((x[:, :WIDTH] != 0).any(axis=1)[:, None], dx[:, :WIDTH], 0))
            each = words.short[of[inside]]
            places, owner = words.gram_places(of[inside], each)
            _descend(net.gram, squares["gram"], pace, gram_row[places], (dx[:, WIDTH : 2 * WIDTH] / each[:, None])[owner])
        if len(watched):
            logits = logits_of(watched)
            worst = np.full(len(labels), -np.inf)
            np.maximum.at(worst, sample.docs[watched], logits)
            history.append(worst)
    return net, history


def _descend(table: np.ndarray, squares: np.ndarray, pace: float, rows: np.ndarray, grad: np.ndarray) -> None:
    """One step for the rows of a table, scaled by their past gradients; the last row stays zero."""
    used, at = np.unique(rows, return_inverse=True)
    total = summed(at, grad, len(used))
    total, used = total[used < len(table) - 1], used[used < len(table) - 1]
    squares[used] += (total * total).mean(axis=1)
    table[used] -= (TABLE_RATE * pace * total / np.sqrt(squares[used])[:, None] + DECAY * pace * table[used]).astype(np.float32)


def calibrated(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float, float]:
    """Scale and shift of logits for documents of which ``share`` is toxic, by weighted logistic regression with smoothed targets; and its loss."""
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(labels == 1, share / max(n[1], 1), (1 - share) / max(n[0], 1)) * len(labels)
    scale, shift = 1.0, math.log(share / (1 - share))
    loss = lambda s, t: float((weight * (np.logaddexp(0, s * logits + t) - target * (s * logits + t))).sum()) + 0.05 * (s - 1) ** 2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -60, 60)))
        d, w = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(d * logits).sum() + 0.1 * (scale - 1), d.sum()])
        curve = np.array([[(w * logits * logits).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-6]])
        move, length, now = np.linalg.solve(curve, grad), 1.0, loss(scale, shift)
        while length > 1e-4 and loss(scale - length * move[0], shift - length * move[1]) > now:
            length /= 2
        scale, shift = scale - length * move[0], shift - length * move[1]
    return max(float(scale), 0.05), float(shift), loss(scale, shift)


def learned(windows: list[list[bytes]], labels: np.ndarray, share: float) -> Network:
    """The network for some documents' windows; ``share``: of toxic documents among all labelled ones."""
    sample = Sample(windows, labels)
    every = list(range(FOLDS))
    watch = every[:: HELD_BACK]
    rest = [f for f in every if f not in watch]
    best, scale, shift = ROUNDS, 1.0, math.log(share / (1 - share))
    if min(*sample.numbers(watch), *sample.numbers(rest)) > 0:
        fits = []
        for logits in train(sample, rest, ROUNDS, watch)[1]:
            held = np.flatnonzero(np.isfinite(logits))
            fits.append(calibrated(logits[held], labels[held], share))
        best = min(range(ROUNDS), key=lambda k: fits[k][2]) + 1
        scale, shift, _ = fits[best - 1]
    net, _ = train(sample, every, best)
    net.scale, net.shift = scale, shift
    return net


def sampled_windows(raw: bytes) -> list[bytes]:
    """At most TRAIN_WINDOWS windows of a text, evenly spread from its first to its last."""
    words = fold(raw).split()
    starts = window_starts(len(words))
    if len(starts) > TRAIN_WINDOWS:
        starts = starts[np.linspace(0, len(starts) - 1, TRAIN_WINDOWS).astype(np.int64)]
    return [b" ".join(words[s : s + WINDOW]) for s in starts]


def fitted(docs: DataFrame, labels: DataFrame) -> bytes | float:
    """The trained network, packed, or the share of toxic labels where only one class is there.

    At most TRAIN_DOCS texts' windows meet in one task, which trains and gives
    back the weights; a lost executor repeats it with the same result.
    """
    # one label for each id; at most TRAIN_DOCS ids, so their broadcast is bounded
    clear = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    numbers = {r.toxic: r["count"] for r in clear.groupBy("toxic").count().collect()}
    share = numbers.get(1, 0) / max(sum(numbers.values()), 1)
    if not 0 < share < 1:
        return float(share)
    ranked = [clear.where(F.col("toxic") == y).select("doc_id", "toxic", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id").limit(TRAIN_DOCS // 2) for y in (0, 1)]
    chosen = F.broadcast(ranked[0].union(ranked[1]))

    def cut(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for rank, doc_ids, toxic, raws in chunks:
            yield {"rank": rank, "doc_id": doc_ids, "toxic": toxic, "windows": [sampled_windows(r) for r in raws]}

    def learn(chunks: Iterator[list[list]]) -> Iterator[dict]:
        rows = [(rank, doc, y, tuple(held)) for cols in chunks for rank, doc, y, held in zip(*cols) if held]
        rows = sorted(set(rows))
        y = np.array([r[2] for r in rows], np.int64)
        both = 0 < y.sum() < len(y)
        yield {"weights": [learned([list(r[3]) for r in rows], y, share).packed() if both else None]}

    source = with_bytes(docs.select("doc_id", "text")).join(chosen, "doc_id")
    windows = map_rows(source, ["rank", "doc_id", "toxic", "raw"], cut, "rank long, doc_id long, toxic int, windows array<binary>")
    found = map_rows(windows.repartition(1), ["rank", "doc_id", "toxic", "windows"], learn, "weights binary").collect()
    return bytes(found[0].weights) if found and found[0].weights is not None else float(share)


def scorer(model: bytes | float) -> Callable[[list[bytes]], list[float]]:
    """Scores of texts by a packed network."""
    if isinstance(model, float):
        return lambda raws: [model if r.split() else 0.0 for r in raws]
    return Network.unpacked(model).probabilities


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(chunks: Iterator[list[list]]) -> Iterator[dict]:
        probabilities = scorer(held.value)
        for doc_ids, held_out, raws in chunks:
            scores = probabilities(raws)
            yield {"doc_id": doc_ids, "held_out": held_out, "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    source = with_bytes(docs).withColumn("held_out", fold_of(F.col("doc_id")) == 2)
    return map_rows(source, ["doc_id", "held_out", "raw"], run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score is under the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    return keep_rows(docs, "text", lambda: scorer(held.value), lambda score: score < THRESHOLD)
