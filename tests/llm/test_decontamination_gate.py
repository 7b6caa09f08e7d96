import random

import numpy as np

from sourceloom.llm import decontaminate as dec

ITEM = "item_id long, text string"


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _others(doc, n=28):
    return " ".join(f"o{doc}x{k}" for k in range(n))


def test_passages_that_many_documents_hold(spark):
    third, every = " ".join(f"third{k}" for k in range(8)), " ".join(f"every{k}" for k in range(12))
    docs = _rows(spark, [_others(d) + " " + (third + " " if d % 3 == 0 else "") + every + " " + _others(-d - 1) for d in range(900)])
    items = spark.createDataFrame([(1, third), (2, every)], ITEM)
    found = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, items).collect()}
    assert found == {(d, 1) for d in range(0, 900, 3)} | {(d, 2) for d in range(900)}
    assert dec.without_contaminated(docs, items).count() == 0


def test_replaced_rare_words(spark):
    words = [f"rare{k}" if k in (1, 3, 5, 7, 9, 11) else f"common{k}" for k in range(20)]
    changed = [w.replace("rare", "swapped") for w in words]
    common = [w for w in reversed(words) if "common" in w]
    docs = _rows(spark, [_others(0) + " " + " ".join(changed) + " " + _others(1)] + [" ".join(common) + " " + _others(d) for d in range(2, 200)])
    found = dec.contaminated(docs, spark.createDataFrame([(5, " ".join(words))], ITEM)).collect()
    assert [(r.doc_id, r.item_id, r.lcs, r.answered) for r in found] == [(0, 5, 0.7, True)]


def test_gate_lets_through_all_windows_that_pass():
    rng = random.Random(3)
    spell = lambda n: [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(n)]
    words = [dec.word_ids(" ".join(spell(rng.choice([1, 5, 12, 30, 64]))).encode()).astype(np.int64).tolist() for _ in range(30)]
    answers = [w[-max(1, len(w) // 4) :] for w in words]
    vocabulary = np.unique(np.array(sum(words, []), np.int64).view(np.uint64))
    space = np.random.default_rng(1).normal(size=(len(vocabulary), 8)).astype(np.float32)
    index = dec.Index(list(range(30)), words, answers, vocabulary, np.ones(len(vocabulary)), space, 1.0)
    texts = [" ".join(spell(rng.choice([0, 3, 60, 128, 700]))).encode() for _ in range(40)]
    want = set()
    for t, raw in enumerate(texts):
        text = dec.word_ids(raw).astype(np.int64).tolist()
        for p, passage in enumerate(words):
            for start in range(0, len(text), dec.STEP):
                near = text[max(0, start - len(passage)) : start + 4 * dec.STEP + len(passage)]
                share = dec.lcs(passage, near) / len(passage)
                if share >= dec.LCS_ALONE or (share >= dec.LCS_WITH_ANSWER and dec.lcs(answers[p], near) >= dec.ANSWER * len(answers[p])):
                    want.add((t, p))
    got = {(t, p) for t, p, text, where in index.search(texts) if index.confirm(p, text, where)}
    assert want and got == want


def test_the_cosine_search_loses_nothing_and_selects_at_full_rank(spark, monkeypatch):
    import numpy as np

    from sourceloom.llm import decontaminate

    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(3000)]
    weights = 1 / np.arange(20, 3020)
    weights /= weights.sum()
    texts = [list(rng.choice(words, 40, p=weights)) for _ in range(60)]
    docs = [" ".join(rng.choice(words, 300, p=weights)) for _ in range(40)]
    docs += [" ".join([*rng.choice(words, 100, p=weights), *(w if rng.random() > 0.25 else "other" for w in texts[k]), *rng.choice(words, 60, p=weights)]) for k in range(20)]
    held = [list(map(int, decontaminate.word_ids(" ".join(t).encode()).astype(np.int64))) for t in texts]
    vocabulary = np.unique(np.concatenate([np.array(h, np.int64).view(np.uint64) for h in held]))
    counts = np.array([sum(v in set(decontaminate.word_ids(d.encode()).tolist()) for d in docs) for v in vocabulary.tolist()])
    idf = 1 + np.log((len(docs) + 1) / (counts + 1))
    passages = spark.createDataFrame([(h,) for h in held], "words array<long>")
    raws = [d.encode() for d in docs]
    found = {}
    for name, rank, dense in (("all", 4, 1 << 13), ("few", 4, 1 << 13), ("half", 30, 0), ("full", 60, 1 << 13), ("full, gathered", 60, 0)):
        monkeypatch.setattr(decontaminate, "DENSE", dense)
        index = decontaminate.Index(list(range(60)), held, [h[-10:] for h in held], vocabulary, idf, decontaminate.latent_space(passages, vocabulary, idf, rank), float(idf.max()))
        if name == "all":
            index.near = lambda stretch, place: np.ones((decontaminate.COUNTED, 60), bool)
        found[name] = sorted((text, passage, tuple(where)) for text, passage, _, where in index.search(raws))
        if name.startswith("full"):
            assert index.chosen < 0.2 * index.seen
    assert len(found["all"]) >= 20 and all(f == found["all"] for f in found.values())
