"""Anchors of several chunks are dealt out at once: the same results, and little said twice where there are many parts."""

import random

from pyspark.sql import functions as F

from sourceloom.llm import common, suffixes


def _texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(3000)]
    shared = [" ".join(rng.choices(words, k=40)) for _ in range(20)]
    rows = [(k, " ".join(rng.choices(words, k=250)) + (rng.choice(shared) if k % 3 == 0 else "")) for k in range(3000)]
    return spark.createDataFrame(rows + [(5, rows[9][1]), (None, rows[9][1]), (3001, None)], "doc_id long, text string").repartition(3)


def _flags(df):
    return {(r.doc_id, r.text_key, r.ask, r.spans[k : k + 4 * n]) for r in df.collect() for n in (3 if r.ask else 2,) for k in range(0, len(r.spans), 4 * n)}


def test_gathered_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 100_000)  # many chunks
    seen = []
    monkeypatch.setattr(suffixes, "_grouped", lambda df, fn, schema, plain=suffixes._grouped: (seen.append(df), plain(df, fn, schema))[1])
    docs, before = _texts(spark), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 256)
    try:
        sent = []
        for size in (1, suffixes.GATHER_BYTES):
            suffixes.first_buckets(docs, size)
            sent.append(seen[-1].where("part >= 0").agg(F.count("*"), F.sum(F.length("payload"))).first())
        assert sent[1][0] <= 3 * 1024 < sent[0][0] and sent[1][1] < 0.9 * sent[0][1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    small, large = (_flags(suffixes.first_buckets(docs, size)) for size in (1, suffixes.GATHER_BYTES))
    assert {x for x in small if not x[2]} == {x for x in large if not x[2]}
