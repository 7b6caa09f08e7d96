"""Registered queries on a whole small table against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sourceloom.llm import packing, queries, separators
from sourceloom.llm.tokens import word_bpe

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_op1_licences(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op1_licenses(spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    known = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    for doc_id, text in texts.items():
        want = {f for notice, f in known.items() if notice in text.split("\n")}
        assert set(filter(None, rows[doc_id].families.split(","))) == want


def test_op2_repeats(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, sf_dir).collect()}
    first: dict[bytes, int] = {}
    for doc_id in sorted(texts):
        raw = texts[doc_id].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], doc_id) < doc_id:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        r = rows[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_op3_finds_all_exact_passages(spark, sf_dir, texts):
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x and x in norm(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf_dir).collect()}
    assert want and want <= got and len(got - want) <= len(want)


def test_op5_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_bpe())
    ids = {d: np.append(np.array(plain.encode(t, add_special_tokens=False).ids, "<u4"), np.uint32(0)) for d, t in texts.items()}
    rows = queries.op5_packing(spark, sf_dir).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length].astype("<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    for d, x in ids.items():
        assert sum(r.length for r in pieces[d].values()) == len(x) and sorted(pieces[d]) == list(range(-(-len(x) // 2048)))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_op7_near_duplicates(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op7_near_duplicates(spark, sf_dir).collect()}
    sets = {}
    for d, t in texts.items():
        w = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in WORD.findall(t.encode())]
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = Counter()
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            for other in where[x]:
                shared[other, d] += 1
            where[x].append(d)
    for (a, b), k in shared.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    for d in texts:
        r = rows[d]
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[d]), find(d), find(d) == d)


def test_op7_groups_with_outsiders(spark):
    """Many near copies of one text, some too far from the first but near others, in one bucket."""
    import random

    from sourceloom.llm.neardup import near_duplicates

    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for d in range(700):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
            words[k] = f"x{d}_{k}"
        docs.append((d, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d in range(len(docs))}


def test_op8_token_counts(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_bpe())
    plain.encode_special_tokens = True
    want = {d: len(plain.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, sf_dir).collect()} == want


def test_op8_flat_files_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separators, "BLOCK_TOKENS", 4)
    rng = np.random.default_rng(1)
    for name in "ab":
        ids = rng.integers(0, 3, 57).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
    rows = separators.count_tokens(separators.flat_files(spark, str(tmp_path)), 0).collect()
    for name in "ab":
        ids = np.frombuffer((tmp_path / name).read_bytes(), "<u2")
        ends = np.flatnonzero(ids == 0)
        want = [(int(x), True) for x in np.diff(ends, prepend=-1) - 1] + ([(len(ids) - int(ends[-1]) - 1, False)] if ends[-1] + 1 < len(ids) else [])
        got = [(r.n_tokens, r.closed) for r in sorted(rows, key=lambda r: r.ordinal) if r.file_id.endswith("/" + name)]
        assert got == want


def test_op8_ids_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "some plain words")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        separators.document_tokens(docs, word_bpe(), 255, "<u1").collect()


def test_op2_bucket_pointers_against_all_pairs():
    """Runs over two letters, so that buckets stay shared for many rounds."""
    from sourceloom.llm.suffixes import LENGTH, repeated

    rng = np.random.default_rng(4)
    for trial in range(30):
        shared = rng.integers(97, 99, 400).astype(np.uint8).tobytes()
        runs, docs = [], []
        for d in range(12):
            at, size = int(rng.integers(0, 300)), int(rng.integers(50, 100))
            runs.append(shared[at : at + size] if rng.random() < 0.7 else bytes([97 + trial % 2]) * size)
            docs.append(int(rng.integers(0, 6)))
        docs = np.array(docs, np.int64)
        first = {}
        for r, d in zip(runs, docs.tolist()):
            for k in range(len(r) - LENGTH + 1):
                first[r[k : k + LENGTH]] = min(d, first.get(r[k : k + LENGTH], d))
        got = repeated(runs, docs, [np.arange(len(r) - LENGTH + 1) for r in runs])
        for r, d, mask in zip(runs, docs.tolist(), got):
            assert mask.tolist() == [first[r[k : k + LENGTH]] < d for k in range(len(r) - LENGTH + 1)]


def test_op9_chat(spark, sf_dir):
    rows = {r.conv_id: r for r in queries.op9_chat(spark, sf_dir).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert rows.keys() == turns.keys()
    for conv, said in turns.items():
        said.sort()
        loss = "".join(t for _, role, t in said if role == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in said).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r.formatted_chars >= len(loss)


def test_op9_windows_keep_the_budget(spark):
    from sourceloom.llm import chat

    turns = [(1, 0, "system", "rules"), *((1, k, "user" if k % 2 else "assistant", f"word{k} " * 40) for k in range(1, 30)), (1, 30, "assistant", "huge " * 900)]
    out = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), word_bpe(), budget=300, history=100).collect()
    assert len(out) > 5 and all(r.oversize == (r.n_tokens > 300) for r in out) and sum(r.oversize for r in out) == 1
    seen = []
    for r in sorted(out, key=lambda r: r.window):
        parsed = chat.parse(r.text)
        assert r.window == 0 or parsed[0] == ("system", "rules")
        seen += parsed[r.n_repeated :]
    assert seen == [(role, text) for _, _, role, text in turns]


def test_op10_order_never_changes_a_verdict(spark, sf_dir):
    from sourceloom.llm import quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {r.doc_id: r for r in quality.judge(docs).collect()}
    b = {r.doc_id: r for r in quality.judge(docs, dict(reversed(quality.RULES.items())), sample_rows=3).collect()}
    assert a == b and 0 < sum(r.kept for r in a.values()) < len(a)


@pytest.mark.parametrize("histogram", [{1: 5}, {2048: 3}, {2047: 2, 1: 2}, {700: 9, 600: 9, 48: 40}])
def test_plan_fills_each_slot_once(histogram):
    taken = defaultdict(list)
    for length, low, high, slots, first, offset in packing.plan(histogram, 2048):
        for rank in range(low, high):
            taken[first + (rank - low) // slots].append((offset + (rank - low) % slots * length, length))
    assert Counter(n for held in taken.values() for _, n in held) == histogram
    for held in taken.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
