"""Contexts that meet by a q-gram alone are not refined; those that share a string are, whichever way it lies."""

import random

import numpy as np
from pyspark.sql import functions as F

from sourceloom.llm import suffixes


def _spans(texts: dict[int, str]) -> dict[int, list[tuple[int, int]]]:
    first, out = {}, {}
    for doc_id in sorted(texts):
        raw = texts[doc_id].encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for k in range(len(raw) - suffixes.LENGTH + 1):
            if first.setdefault(raw[k : k + suffixes.LENGTH], doc_id) < doc_id:
                gone[k + 1 : k + 1 + suffixes.LENGTH] = 1
        edge = np.flatnonzero(np.diff(gone)).tolist()
        out[doc_id] = list(zip(edge[::2], edge[1::2]))
    return out


def _got(docs):
    return {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.remove_repeats(docs).collect()}


def test_shared_strings_at_every_place(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(12)] + ["ab" * 60, "a" * 90, ("xyz, " * 4 + "q") * 6, "-" * 49 + "+" + "-" * 49]
    texts = {}
    for doc_id in range(400):
        pieces = []
        for _ in range(rng.randrange(1, 6)):
            pieces.append(" ".join(word() for _ in range(rng.randrange(0, 30))))
            some = rng.choice(shared)
            at = rng.randrange(len(some))
            pieces.append(some[at : at + rng.randrange(30, 75)])
        texts[doc_id] = rng.choice(["", " "]).join(pieces)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert _got(docs) == _spans(texts)


def test_chance_meetings_are_not_refined(spark):
    """Of few long words, so that q-grams are in many documents but strings are not."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=18)) for _ in range(300)]
    texts = {k: " ".join(rng.choices(words, k=60)) for k in range(500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked = suffixes.first_buckets(docs).where("ask").agg(F.sum(F.length("spans")) / 12).first()[0] or 0
    anchors = sum(len(suffixes.anchors([t.encode()])["gram"]) for t in texts.values())
    assert asked < 0.3 * anchors  # 0.54 of them before sides were compared
    assert _got(docs) == _spans(texts)
