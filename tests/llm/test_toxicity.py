"""Held-out quality of the toxicity network on the shared tables, and where it is trained."""

import numpy as np
import pytest

from sourceloom.llm import toxicity
from sourceloom.llm.queries import op4_toxicity


@pytest.mark.parametrize("size,recall,false_share", [("sf0.01", 0.6, 0.05), ("sf0.1", 0.9, 0.025)])
def test_held_out_quality(spark, size, recall, false_share):
    sf_dir = f"/root/testdata/{size}"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op4_toxicity(spark, sf_dir).where("held_out").collect() if labels.get(r.doc_id) is not None]
    truth, found = np.array([labels[r.doc_id] for r in rows]) == 1, np.array([r.predicted for r in rows]) == 1
    assert (found & truth).sum() >= recall * truth.sum() and (found & ~truth).sum() <= false_share * (~truth).sum()


def test_long_labelled_texts_are_learned_from(spark):
    """Texts of thousands of words with one telling word: their windows are sampled, none is left out by size."""
    rng = np.random.default_rng(1)
    filler = lambda n: [f"{a}{b}{c}" for a, b, c in rng.choice(list("aeioulnrst"), (n, 3))]
    docs, labels = [], []
    for d in range(160):
        words = filler(3000 if d % 2 else 40)
        if d % 4 < 2:
            words[:: 12] = ["zorkful"] * len(words[::12])
        docs.append((d, " ".join(words)))
        labels.append((d, int(d % 4 < 2)))
    rows = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.predicted == int(r.doc_id % 4 < 2) for r in rows)


def test_packed_network_scores_alike():
    words = toxicity.Words([b"some words and more words"])
    net = toxicity.Network(words.hashes, np.unique(words.grams))
    net.scale, net.shift = 0.5, -0.25
    texts = [b"some more", b"", b"unknown WORDS and " * 50]
    assert toxicity.Network.unpacked(net.packed()).probabilities(texts) == net.probabilities(texts) and net.probabilities(texts)[1] == 0


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        starts = toxicity.window_starts(n)
        covered = {w for s in starts for w in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))
    long = b" ".join(b"w%d" % k for k in range(100_000))
    held = toxicity.sampled_windows(long)
    assert len(held) == toxicity.TRAIN_WINDOWS and held[0].startswith(b"w0 ") and held[-1].endswith(b"w99999")
