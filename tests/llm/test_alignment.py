"""Token alignment against whole texts and byte offsets."""

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest

from sourceloom.llm import alignment
from sourceloom.llm.tokens import vocabulary

from .conftest import ODD

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = ["hello  world", "\nline one\nline two", " lead", "tab\tx y", "trail ", "ﬁ ½ é é 　x", "a\xa0b c", "a\x00b", "▁x y", "</s> <s> <|endoftext|> <0x0A>", " ", "\n", "a\n\nb \n c", "naïve café 漢字 かな 😀 end", "x\r\ny", "it's they'll 12345 3.14", "<|endoftext|>", "word\n", "a \nb", "sp▁ace", "é ́x", "﻿bom", "end line x", "a\x1cb \x1dc"]


def plain(rows):
    """rows: (doc_id, text)"""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    held, counts = [], Counter()
    for doc_id, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        b = second.encode(text or "")
        a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            held.append((doc_id, [], [], [], ""))
            continue
        ends = []
        for part in (a_bytes, b_bytes):
            at, out = 0, []
            for t in part:
                at += len(t)
                out.append(at)
            ends.append(out)
        both = sorted({*ends[0]} & {*ends[1]})
        groups, links = [([], []) for _ in both], []
        for side, (ids, places) in enumerate(((a.ids, ends[0]), (b, ends[1]))):
            for i, e in zip(ids, places):
                groups[bisect_left(both, e)][side].append(i)
        by_end = defaultdict(list)
        for i, e in zip(a.ids, ends[0]):
            by_end[e].append(i)
        for j, e in zip(b, ends[1]):
            links += [(i, j) for i in by_end[e]]
        counts.update(links)
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        held.append((doc_id, a.ids, b, links, hashlib.sha256(text.encode()).hexdigest(), len(groups)))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    for doc_id, a, b, links, digest, *n_groups in held:
        yield (doc_id, len(a), len(b), n_groups[0] if n_groups else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r[:-1]) + (r[-1],))


def found(docs, **options):
    return ordered(map(tuple, alignment.token_alignment(docs, *PATHS, **options).collect()))


@pytest.mark.parametrize("hot_pairs", [1 << 17, 20])
def test_documents(spark, sf_dir, hot_pairs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert found(docs, hot_pairs=hot_pairs) == ordered(plain([(r.doc_id, r.text) for r in docs.collect()]))


def test_white_space_and_signs(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == ordered(plain(rows))


def test_odd(odd, none):
    assert found(odd) == ordered(plain([(i, t) for i, t, _, _ in ODD]))
    assert found(none) == []


def test_units_may_be_whole_texts():
    cut, whole = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS)
    assert cut.cuts
    whole.cuts = False
    for a, b in zip(cut.align(TEXTS), whole.align(TEXTS)):
        assert (a is None) == (b is None) and (a is None or (*a[:3], a[3].tolist()) == (*b[:3], b[3].tolist()))


def test_memo_starts_anew(monkeypatch):
    held, small = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS)
    monkeypatch.setattr(alignment, "MEMO_UNITS", 3)
    monkeypatch.setattr(alignment, "MEMO_CHARS", 4)
    for text in TEXTS:
        a, b = next(held.align([text])), next(small.align([text]))
        assert (a is None) == (b is None) and (a is None or a[:3] == b[:3])
