"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. Inverse document frequencies of their
words are counted over all documents; a randomised SVD of the passages' TF-IDF
rows, with its sums made by Spark, gives a latent space. Stretches of documents,
their benchmark words alone, are folded into it and searched by cosine. The threshold of
a pair is a floor that each stretch with enough of a passage's words is over
(``Index.near``), whatever the rank and however common or rare the words, so the
search loses nothing. What it finds is compared with a passage if it has so many of its
words (each counted as often as the passage has it) that their longest common
subsequence can be long enough; its windows are tried from the highest cosine
down, and one passes if its longest common subsequence with the passage is long enough,
or shorter but with the passage's answer present, so paraphrases count.

The benchmark is the stated query set: it is taken in blocks of ``BLOCK``
passages, each one more pass over the documents, so what is broadcast has a
bound. A window's cosine uses its whole weight; a word unknown to the benchmark
has the highest weight of the block's words. No weight is zero.

Defined results: one row for each document row and item that match, with the
best passage's figures; a null or empty text matches nothing, and a benchmark
item without words is matched by nothing; repeated rows give repeated rows; a
null doc_id or item_id stays null; either table may be empty; texts are searched
whole; other columns are not looked at, except ``answer`` of the benchmark,
where there is one (else the last quarter of an item stands for it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_rows, with_bytes
from .neardup import word_hashes

#: words of a passage and of a step; windows have two and four steps
PASSAGE, STEP = 64, 16
RANK, OVERSAMPLE, POWERS = 64, 16, 2
#: the rank grows fourfold until each passage keeps this share of its length in latent space
KEPT = 0.99
#: passages in one pass over the documents, and tasks that sum over them
BLOCK, SUMS = 512, 4
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
#: windows' starts in a stretch, words looked up at a time, stretches counted at a time
STARTS, WORDS_HELD, COUNTED = 8, 1 << 16, 64
#: words of a vocabulary up to which stretches are multiplied as rows of a matrix
DENSE = 1 << 13

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_ids(text: bytes) -> np.ndarray:
    """Hashes of a text's words in lower case, without punctuation."""
    return word_hashes((text if text.isascii() else text.decode("utf-8", "replace").lower().encode()).translate(_FOLD))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def passages_of(items: DataFrame) -> DataFrame:
    """item_id, words (hashes) and answer (hashes) of each passage."""
    has_answer = "answer" in items.columns
    source = with_bytes(items).withColumn("_answer", F.coalesce(F.col("answer").cast("string"), F.lit("")).cast("binary") if has_answer else F.lit(b""))

    def cut(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for item_ids, raws, answers in chunks:
            out: dict[str, list] = {"item_id": [], "words": [], "answer": []}
            for item_id, raw, answer in zip(item_ids, raws, answers):
                words = word_ids(raw).astype(np.int64)
                told = word_ids(answer).astype(np.int64)
                for at in range(0, max(1, len(words) - STEP), PASSAGE - STEP):
                    part = words[at : at + PASSAGE]
                    if len(part):
                        out["item_id"].append(item_id)
                        out["words"].append(part)
                        out["answer"].append(told if len(told) else part[-max(1, len(part) // 4) :])
            yield out

    return map_rows(source, ["item_id", "raw", "_answer"], cut, "item_id long, words array<long>, answer array<long>")


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the (sorted) words is, and how many documents there are."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(chunks: Iterator[list[list]]) -> Iterator[dict]:
        known = held.value
        total, rows = np.zeros(len(known), np.int64), 0
        for (raws,) in chunks:
            rows += len(raws)
            for at in range(0, len(raws), 512):
                some = raws[at : at + 512]
                ids = [word_ids(r) for r in some]
                words = np.concatenate(ids)
                owner = np.repeat(np.arange(len(some)), [len(x) for x in ids])
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = known[place] == words
                seen = np.zeros((len(some), len(known)), bool)
                seen[owner[hit], place[hit]] = True
                total += seen.sum(axis=0)
        found = np.flatnonzero(total)
        yield {"word": [-1, *found], "n": [rows, *total[found]]}

    rows = map_rows(with_bytes(docs), ["raw"], count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(vocabulary), np.int64), 0
    for r in rows:  # one row for each word of the benchmark block at most
        if r.word < 0:
            n = r.n
        else:
            out[r.word] = r.n
    return out, n


def latent_space(passages: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """Words x rank: right singular vectors of the passages' TF-IDF rows, by subspace iteration."""
    width = min(rank + OVERSAMPLE, len(vocabulary))
    basis = np.random.default_rng(7).normal(size=(len(vocabulary), width))
    context = passages.sparkSession.sparkContext

    def product(basis: np.ndarray) -> np.ndarray:
        """A'A basis, summed over the tasks' passages."""
        held = context.broadcast((vocabulary, idf, basis))

        def part(chunks: Iterator[list[list]]) -> Iterator[dict]:
            known, weight, right = held.value
            total = np.zeros_like(right)
            for (texts,) in chunks:
                for words in texts:
                    at, tf = np.unique(np.searchsorted(known, np.array(words, np.int64).view(np.uint64)), return_counts=True)
                    row = tf * weight[at]
                    row /= np.linalg.norm(row) or 1
                    total[at] += np.outer(row, row @ right[at])
            yield {"sums": [total.astype(np.float32).tobytes()]}

        # a row for each task over a block of passages, each words x rank
        out = np.zeros(basis.shape)
        for r in map_rows(passages.coalesce(SUMS), ["words"], part, "sums binary").toLocalIterator():
            out += np.frombuffer(r.sums, np.float32).reshape(basis.shape)
        held.destroy()  # the driver holds no basis longer than its product
        return out

    for _ in range(POWERS):
        basis = np.linalg.qr(product(basis))[0]
    image = product(basis)
    values, inner = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    return (basis @ inner[:, np.argsort(-values)[: min(rank, width)]]).astype(np.float32)


class Index:
    """Passages in latent space, and the exact checks."""

    def __init__(self, items: list, words: list[list[int]], answers: list[list[int]], vocabulary: np.ndarray, idf: np.ndarray, space: np.ndarray, unknown: float) -> None:
        self.items, self.words, self.answers, self.vocabulary = items, words, answers, vocabulary
        self.seen = self.chosen = 0  # pairs of stretches and passages, and those over their floor
        space = np.linalg.qr(space)[0]  # lengths are those of projections
        self.vectors = np.concatenate([space * idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
        self.squares = np.append(idf**2, unknown**2).astype(np.float32)
        latent = np.array([self.vectors[np.searchsorted(vocabulary, np.array(w, np.int64).view(np.uint64))].sum(axis=0) for w in words])
        whole = np.zeros(len(words))
        for k, w in enumerate(words):
            at, tf = np.unique(np.searchsorted(vocabulary, np.array(w, np.int64).view(np.uint64)), return_counts=True)
            whole[k] = np.linalg.norm(tf * idf[at])
        self.kept = float((np.linalg.norm(latent, axis=1) / np.maximum(whole, 1e-9))[whole > 1e-6].min(initial=1.0))
        self.sizes = np.maximum(np.linalg.norm(latent, axis=1), 1e-9).astype(np.float32)
        self.queries = (latent / self.sizes[:, None]).T.astype(np.float32)
        # the passages of each word, and how often the word is in them
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        place = np.searchsorted(vocabulary, np.concatenate([np.array(w, np.int64) for w in words]).view(np.uint64))
        pairs, self.times = np.unique(place * len(words) + owner, return_counts=True)
        self.holders = pairs % len(words)
        self.ends = np.cumsum(np.bincount(pairs // len(words), minlength=len(vocabulary)))
        self.held = np.diff(self.ends, prepend=0)
        # the shortest common subsequence that could pass
        self.least = np.array([next(k for k in range(len(w) + 1) if k / len(w) >= LCS_WITH_ANSWER) for w in words])
        self.longest = max(map(len, words))
        # a stretch with so many of a passage's words has this product with it at least: that of the passage's lightest words
        self.floors = np.array([np.sort(idf[np.searchsorted(vocabulary, np.array(w, np.int64).view(np.uint64))] ** 2)[:least].sum() for w, least in zip(words, self.least)], np.float32)
        whole = whole.astype(np.float32)
        self.outside = np.sqrt(np.maximum(whole**2 - self.sizes**2, 0))  # what of a passage lies outside the latent space

    def places(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or its length."""
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == words, place, len(self.vocabulary))

    def near(self, stretch: np.ndarray, place: np.ndarray) -> np.ndarray:
        """COUNTED stretches x passages: whose cosine in latent space is over the pair's floor.

        A stretch with enough of a passage's words has a product of ``floors`` with it
        at least; of this the latent space misses no more than the parts of both that lie
        outside allow, so a cosine under what is left cannot belong to such a stretch.
        """
        norm = np.bincount(stretch, self.squares[place], COUNTED).astype(np.float32)
        if len(self.vocabulary) <= DENSE:
            held = np.zeros((COUNTED, len(self.vectors)), np.float32)
            held[stretch, place] = 1
            latent = held @ self.vectors
        else:
            latent = np.zeros((COUNTED, self.vectors.shape[1]), np.float32)
            first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1])) if len(place) else np.zeros(0, np.int64)
            if len(first):
                latent[stretch[first]] = np.add.reduceat(self.vectors[place], first, axis=0)
        inside = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
        outside = np.sqrt(np.maximum(norm - inside**2, 0))
        cosine = (latent @ self.queries) / inside[:, None]
        floor = (0.999 * self.floors - outside[:, None] * self.outside) / (inside[:, None] * self.sizes)
        return (cosine >= floor) & (norm[:, None] > 0)

    def search(self, raws: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
        """(text, passage, the text's words, stretches) for each passage a text may hold."""
        ids = [word_ids(r) for r in raws]
        at = 0
        while at < len(ids):
            stop, size = at, 0
            while stop < len(ids) and (stop == at or size + len(ids[stop]) <= WORDS_HELD):
                size += len(ids[stop])
                stop += 1
            yield from self._some(at, ids[at:stop])
            at = stop

    def _some(self, first: int, ids: list[np.ndarray]) -> Iterator[tuple]:
        step, reach, n = STARTS * STEP, self.longest, len(self.vocabulary)
        sizes = np.array([len(x) for x in ids])
        counts = -(-sizes // step)
        if not counts.sum():
            return
        owner = np.repeat(np.arange(len(ids)), counts)
        before = np.cumsum(counts) - counts
        place = self.places(np.concatenate(ids))
        at = np.flatnonzero(place < n)
        text = np.repeat(np.arange(len(ids)), sizes)[at]
        place, inner = place[at], at - (np.cumsum(sizes) - sizes)[text]
        # a stretch's windows see the words from ``reach`` before the first to ``reach`` after the last
        keys = []
        for k in range((step + 3 * STEP + 2 * reach) // step + 1):
            stretch = (inner + reach) // step - k
            seen = (stretch >= 0) & (stretch < counts[text]) & (inner < (stretch + 1) * step + 3 * STEP + reach)
            keys.append((before[text[seen]] + stretch[seen]) * n + place[seen])
        stretches, place = np.divmod(np.unique(np.concatenate(keys)), n)
        found: dict[tuple[int, int], list[int]] = {}
        for low in range(0, len(owner), COUNTED):
            part = slice(*np.searchsorted(stretches, (low, low + COUNTED)))
            near = self.near(stretches[part] - low, place[part])
            self.seen += near.size
            self.chosen += int(near.sum())
            some = near.any(axis=1)[stretches[part] - low]
            if not some.any():
                continue
            at, words = stretches[part][some] - low, place[part][some]
            held = self.held[words]
            entry = np.arange(held.sum()) + np.repeat(self.ends[words] - np.cumsum(held), held)
            shared = np.bincount(np.repeat(at, held) * len(self.words) + self.holders[entry], self.times[entry], COUNTED * len(self.words))
            for stretch, passage in zip(*np.nonzero(near & (shared.reshape(COUNTED, -1) >= self.least))):
                text_at = int(owner[low + stretch])
                found.setdefault((text_at, int(passage)), []).append(int(low + stretch - before[text_at]))
        for (text_at, passage), where in found.items():
            yield first + text_at, passage, ids[text_at], where

    def confirm(self, passage: int, words: np.ndarray, stretches: list[int]) -> tuple[float, float, bool] | None:
        """(share of the passage in order, cosine, answer present) at the likeliest place that passes."""
        want, answer = self.words[passage], self.answers[passage]
        known = np.array([*want, *answer], np.int64)
        windows = []
        for stretch in stretches:
            begin = stretch * STARTS * STEP
            end = min(begin + STARTS * STEP, len(words))
            near = words[max(0, begin - len(want)) : end + 3 * STEP + len(want)].astype(np.int64)
            if lcs(want, near[np.isin(near, known)].tolist()) < self.least[passage]:
                continue  # no window has more than the whole stretch
            for start in range(begin, end, STEP):
                for width in (2 * STEP, 4 * STEP):
                    place = self.places(words[start : start + width])
                    cosine = self.vectors[place].sum(axis=0) @ self.queries[:, passage] / np.sqrt(self.squares[place].sum())
                    windows.append((float(cosine), start, width))
        for cosine, start, width in sorted(windows, reverse=True):
            near = words[max(0, start - len(want)) : start + width + len(want)].astype(np.int64)
            near = near[np.isin(near, known)].tolist()
            share = lcs(want, near) / len(want)
            if share < LCS_WITH_ANSWER:
                continue
            told = lcs(answer, near) >= ANSWER * len(answer)
            if share >= LCS_ALONE or told:
                return share, cosine, told
        return None


MATCHES = "doc_id long, item_id long, cosine double, lcs double, answered boolean"


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The query set's passages, a block at a time."""
    block = []
    for row in passages_of(benchmark).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCHES: the documents that hold benchmark passages, exact or in other words."""
    out = None
    for block in _blocks(benchmark):
        found = _block(docs, block)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no benchmark passage."""

    def judge(held):
        def run(raws: list[bytes]) -> list[bool]:
            clean = [True] * len(raws)
            for text, passage, found, places in held.value.search(raws):
                if clean[text] and held.value.confirm(passage, found, places):
                    clean[text] = False
            return clean

        return lambda: run

    kept = docs
    for block in _blocks(benchmark):
        kept = keep_rows(kept, "text", judge(_index(docs, block)), bool)
    return kept


def _index(docs: DataFrame, block: list):
    """The broadcast index of a block, of bounded size."""
    spark = docs.sparkSession
    words = [list(r.words) for r in block]
    vocabulary = np.unique(np.concatenate([np.array(w, np.int64).view(np.uint64) for w in words]))
    frequency, n = document_frequencies(docs, vocabulary)
    idf = 1 + np.log((n + 1) / (frequency + 1))
    unknown = float(idf.max())
    passages = spark.createDataFrame([(w,) for w in words], "words array<long>")
    rank = RANK
    while True:
        space = latent_space(passages, vocabulary, idf, rank)
        made = Index([r.item_id for r in block], words, [list(r.answer) for r in block], vocabulary, idf, space, unknown)
        if made.kept >= KEPT or rank >= min(len(block), len(vocabulary)):
            break
        rank = min(4 * rank, len(block), len(vocabulary))
    return spark.sparkContext.broadcast(made)


def _block(docs: DataFrame, block: list) -> DataFrame:
    held = _index(docs, block)

    def run(chunks: Iterator[list[list]]) -> Iterator[dict]:
        index = held.value
        for doc_ids, raws in chunks:
            best: dict[tuple[int, int], tuple] = {}
            for text, passage, found, places in index.search(raws):
                checked = index.confirm(passage, found, places)
                if checked:
                    key = (text, index.items[passage])
                    best[key] = max(best.get(key, (-1.0,)), checked)
            keys = sorted(best, key=lambda k: (k[0], k[1] is not None, k[1] or 0))
            yield {
                "doc_id": [doc_ids[k[0]] for k in keys],
                "item_id": [k[1] for k in keys],
                "cosine": [best[k][1] for k in keys],
                "lcs": [best[k][0] for k in keys],
                "answered": [best[k][2] for k in keys],
            }

    return map_rows(with_bytes(docs), ["doc_id", "raw"], run, MATCHES)
