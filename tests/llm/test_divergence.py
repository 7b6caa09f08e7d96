"""The divergence audit against a plain version in Python's numbers."""

import re
from collections import Counter, defaultdict

import pytest

from sourceloom.llm import divergence

from .conftest import ODD

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least_docs=30, top=50):
    """rows: (text, lang, source)"""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = [s for g, s in groups if g == lang]
        held = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        every = {t: sum(held[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p, q = {s: share(held[s]) for s in sources}, share(every)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            lead = [(p[s][t] - q[t], t) for t in kept if held[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", lead, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    yield (lang, s, part, item, value, rank)


def found(docs, **options):
    return sorted(map(tuple, divergence.audit(docs, **options).collect()))


@pytest.mark.parametrize("block_rows", [divergence.BLOCK_ROWS, 3])
def test_small_groups(spark, block_rows):
    words = ["the", "The", "cat", "été", "ÉTÉ", "naïve", "x_y", "don't", "漢字", "zz9zz", "of"]
    rows = [(" ".join(words[(k * j + j // 3) % len(words)] for j in range(k % 17)), ["en", "fr", None][k % 3], ["a", "b", None, "d"][(k // 3) % 4 if k % 7 else 0]) for k in range(120)]
    rows += [("lonely words", "xx", "only"), (None, "yy", "p"), ("", "yy", "q"), ("no kept term", "yy", "r"), (None, "en", "silent")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for least in (1, 3, 30):
        assert found(docs, least_docs=least, top_terms=4, block_rows=block_rows) == sorted(plain(rows, least, 4))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs) == sorted(plain([(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]))


def test_odd(odd, none):
    assert found(odd, least_docs=1) == sorted(plain([(t, lang, "s") for _, t, lang, _ in ODD], 1))
    assert found(none) == []
