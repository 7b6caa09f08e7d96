"""Exact duplicates against a plain version, with long texts in chunks and with fingerprints that collide."""

import hashlib
import re
from collections import defaultdict

import pytest

from sourceloom.llm import fingerprints

from .conftest import ODD

CASES = [(1, "a  b"), (1, "a b"), (2, "a\n b"), (None, "a b"), (None, None), (3, ""), (4, " "), (5, "\t\n"), (6, "ab"), (7, "ba"), (8, "cc"), (9, "x" * 3000), (10, "x" * 3000), (11, "x" * 2999 + "y"), (6, "ab"), (None, "zz"), (None, "zz"), (-1, "zz"), (12, "y" + "x" * 2999), (13, "x" * 2999 + "y")]


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        for k, doc_id in enumerate(ids):
            yield (doc_id, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r[:4]) + (r[4],))


def found(docs, **options):
    return ordered((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in fingerprints.exact_duplicates(docs, **options).collect())


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 256}, {"moduli": (2, 2, 2, 2)}, {"moduli": (2, 2, 2, 2), "chunk_bytes": 256}])
def test_cases(spark, options):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    assert found(docs, **options) == ordered(plain(CASES))


def test_odd(odd, none):
    assert found(odd) == ordered(plain([(i, t) for i, t, _, _ in ODD]))
    assert found(none) == []
    kept = fingerprints.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({re.sub(r"\s+", " ", t or "") for _, t, _, _ in ODD})


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs, chunk_bytes=1024) == ordered(plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_many_copies_are_salted(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SALT_ROWS", 4)
    rows = [(k, "copy of one text") for k in range(60)] + [(100 + k, f"other {k}") for k in range(20)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == ordered(plain(rows))


def test_chunks_compose():
    whole, parts = b"some text that is longer than a block " * 40, []
    hasher = fingerprints.Hasher()
    for at in range(0, len(whole), 100):
        part = whole[at : at + 100]
        parts.append(fingerprints._shifted(hasher([part])[0].tolist(), len(whole) - at - len(part), fingerprints.MODULI))
    assert [sum(c) % m for c, m in zip(zip(*parts), fingerprints.MODULI)] == hasher([whole])[0].tolist()
