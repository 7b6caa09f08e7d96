"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import numpy as np
import pytest

import corpus_pipeline
from sourceloom.llm import chat, decontaminate, licenses, neardup, packing, pii, quality, separators, suffixes, toxicity
from sourceloom.llm.queries import END_OF_TEXT
from sourceloom.llm.tokens import word_bpe

from .conftest import CLASHES, ODD


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, None), (5, 0), (5, 1), (None, 1), (7, 0)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "no id here but words enough to count"), (None, "one two three four five six seven")], "item_id long, text string")


def test_licences(odd, none):
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(ODD) and all(r.families == "" for r in rows)
    assert licenses.scan(none).collect() == []


def test_repeats(odd, none):
    rows = suffixes.remove_repeats(odd).collect()
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t, _, _ in ODD)
    assert all(not r.spans for r in rows)  # nothing repeats over documents
    assert suffixes.remove_repeats(none).collect() == []


def test_repeats_across_ties(spark):
    text = "abcdefghij" * 8
    rows = suffixes.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "x" * 200), (4, "x" * 120)], "doc_id long, text string")).collect()
    kept = sorted((r.doc_id or 0, len(r.kept)) for r in rows)
    assert kept == [(0, 80), (1, 80), (1, 80), (2, 0), (3, 200), (4, 0)]


def test_decontamination(odd, none, benchmark):
    rows = decontaminate.contaminated(odd, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in rows) == [(0, 3), (1, 0), (1, 0), (5, 0)]
    kept = decontaminate.without_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert decontaminate.contaminated(none, benchmark).collect() == []
    assert decontaminate.contaminated(odd, benchmark.limit(0)).collect() == []


def test_paraphrases_count(spark):
    words = [f"term{k}" for k in range(40)]
    changed = [w if k % 5 else "other" for k, w in enumerate(words)]
    others = [(100 + d, " ".join(f"h{d}_{k}" for k in range(60))) for d in range(60)]
    docs = spark.createDataFrame(others + [(1, " ".join(f"f{k}" for k in range(90)) + " " + " ".join(changed)), (2, " ".join(words[:8]) + " " + " ".join(f"g{k}" for k in range(50)))], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 9)]


def test_toxicity(odd, none, labels):
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert toxicity.score(none, labels).collect() == []
    assert {r.score for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns


def test_packing(odd, none):
    rows = packing.pack(odd, word_bpe()).collect()
    assert {r.doc_id for r in rows} == {i for i, *_ in ODD}
    assert sum(r.length for r in rows if r.doc_id == 7) == 60_001
    assert sorted(r.length for r in rows if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    assert packing.pack(none, word_bpe()).collect() == []


def test_near_duplicates(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 1 and not by[5].kept and by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[3].kept
    assert by[7].n_shingles == 1 and by[None].component_id is None
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert all(r[c] == c for r in kept.collect() for c in CLASHES)
    assert neardup.near_duplicates(none).collect() == [] and neardup.deduplicated(none).collect() == []


def test_token_counts(odd, none):
    rows = separators.document_tokens(odd, word_bpe(), END_OF_TEXT).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.n_tokens for r in rows}[7] == 60_000
    assert separators.document_tokens(none, word_bpe(), END_OF_TEXT).collect() == []


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, None, None, 5), (1, 0, None, None, 5), (1, None, "user", "", 5), (None, 1, "assistant", "x[TEXT]", 5), (2, 1, "[/ROLE]", "</s>", 5)], "conv_id long, turn long, role string, text string, window int")
    rows = {r.conv_id: r for r in chat.read_back(chat.windows(turns, word_bpe())).collect()}
    assert {k: r.n_turns for k, r in rows.items()} == {1: 3, None: 1, 2: 1} and rows[None].loss_chars == 7
    assert chat.read_back(chat.windows(turns.limit(0), word_bpe())).collect() == []


def test_quality(odd, none):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 50)
    assert quality.judge(none).collect() == []


def test_personal_data(odd, none):
    assert len(pii.report(odd).collect()) == len(ODD)
    out = pii.redact(odd)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == odd.columns and rows[8].text.endswith("[EMAIL]") and rows[2].text is None
    assert all(rows[8][c] == c for c in CLASHES)
    assert pii.redact(none).collect() == []


def test_network_gradient():
    """Analytic gradients of the toxicity network against differences."""
    words = toxicity.Words([b"aa bb cc dd ee"])
    net = toxicity.Network(words.hashes, np.unique(words.grams))
    x = net.vectors(words)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at, live = np.array([[0, 1, 2, 5], [3, 4, 1, 0]]), np.array([[True, True, True, False], [True] * 4])
    loss = lambda: float((net.forward(net.project(x), at, live) * [1.0, -0.5]).sum())
    keep = {}
    net.forward(net.project(x), at, live, keep)
    grads, dx = net.backward(keep, at, live, x, np.array([1.0, -0.5]))
    for name, g in grads.items():
        flat, k = net.p[name].reshape(-1), int(np.abs(g).argmax())
        old = flat[k]
        flat[k] = old + 1e-3
        up = loss()
        flat[k] = old - 1e-3
        down = loss()
        flat[k] = old
        assert abs((up - down) / 2e-3 - g.reshape(-1)[k]) < 1e-2 * max(1, abs(g.reshape(-1)[k])), name


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_documents(spark, odd, labels, benchmark, tmp_path, empty):
    """Nulls, long and repeated texts, clashing columns, and empty tables, through all stages."""
    (odd.limit(0) if empty else odd).write.parquet(f"{tmp_path}/documents.parquet")
    (labels.limit(0) if empty else labels).write.parquet(f"{tmp_path}/labels.parquet")
    (benchmark.limit(0) if empty else benchmark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (rows == []) if empty else {2, 3, 4} <= {r.doc_id for r in rows}


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its predecessor's rows, against what its operator says of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    single = stages["near_duplicates"](spark, clean, sf_dir)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in neardup.near_duplicates(clean).where("kept").collect()}
    assert clean.columns == single.columns == docs.columns
    final = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(final.columns) and final.count() > 0
