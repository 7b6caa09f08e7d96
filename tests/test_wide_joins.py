"""Joins of small files with many rows: whole results, no side held whole, no pairs gathered."""

import random
import re

from sourceloom.operators import graphs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _overlaps(texts, least):
    sets = {k: {w for w in re.split(r"\W+", (t or "").lower()) if w} for k, t in texts}
    return {(a, b): len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) > least}


def test_similar_issues_in_blocks(spark):
    rng = random.Random(5)
    words, weights = [f"w{k}" for k in range(25)], [1 / (k + 1) for k in range(25)]
    texts = [(k, "All " + " ".join(rng.choices(words, weights, k=rng.randrange(9)))) for k in range(90)] + [(200, None), (201, ""), (202, "all"), (203, "ALL, all!")]
    issues = spark.createDataFrame(texts, "id long, text string")
    for least, block in ((0.5, 1), (0.5, 7), (0.5, 1024), (0.8, 3), (0.0, 7)):
        rows = graphs.similar_issues(issues, least, block).collect()
        assert len(rows) == len({(r.a, r.b) for r in rows})
        assert {(r.a, r.b): r.overlap for r in rows} == _overlaps(texts, least), (least, block)


def test_similar_pairs_are_not_gathered(spark):
    plan = _plan(graphs.similar_issues(spark.createDataFrame([(1, "a b"), (2, "b a")], "id long, text string")))
    assert not re.search(r"Aggregate ?\(keys=\[a#\d+L?, b#", plan)


def test_name_keys_are_not_broadcast(spark, tmp_path):
    left = spark.createDataFrame([(k, f"H_PART{k % 7}") for k in range(50)], "id long, name string")
    right = spark.createDataFrame([(k, f"PART{k}") for k in range(7)], "id long, name string")
    left.write.parquet(f"{tmp_path}/left")
    right.write.parquet(f"{tmp_path}/right")  # a file's small size is known
    links = graphs.name_links(spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/right"), "USED_IN")
    assert "Broadcast" not in _plan(links)
    assert sorted((r.source_id, r.target_id, r.rule) for r in links.collect()) == [(k, k % 7, "stripped") for k in range(50)]
