"""Searches against a scan of all notes, routes against one rule after the other."""

import random
import re

from sourceloom.functions import automaton
from sourceloom.operators import search


def test_many_searches(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    weights = [1 / (k + 1) for k in range(30)]
    notes = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(12)))) for k in range(400)] + [(900, None), (901, "W0\tw1\n W0")]
    queries = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for k in range(60)] + [(900, None), (901, "nothing known"), (902, "w0"), (903, "W0 w1 unknown")]
    path = search.write_index(spark.createDataFrame(notes, "entry_id long, content string").repartition(7))
    for most in (1, 5, 1000):
        got = {}
        for r in search.search(spark, path, spark.createDataFrame(queries, "query_id long, text string"), most).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.entry_id, r.hits, round(r.score, 9)))
        for q, text in queries:
            asked = set((text or "").lower().split())
            scored = sorted((-len(asked & set((t or "").lower().split())), i) for i, t in notes)
            want = [(k + 1, i, -s, round(-s / len(asked), 9)) for k, (s, i) in enumerate(x for x in scored if x[0]) if k < most]
            assert sorted(got.get(q, [])) == want, (q, most)


def plain_route(rules, text):
    for target, _, _, pattern in sorted(rules, key=lambda r: (-r[1], r[2])):
        try:
            if re.search(pattern, text, re.I):
                return target
        except re.error:
            pass
        if pattern.lower() in text.lower():
            return target
    return None


def test_routes(spark):
    rng = random.Random(6)
    rules = [(f"t{k}", rng.randrange(5), k, "".join(rng.choice("abAB") for _ in range(rng.randrange(1, 6)))) for k in range(60)]
    rules += [("expression", 3, 100, r"^b+a$"), ("broken", 4, 101, "(ab"), ("group", 2, 102, r"(a|b)\1c?d"), ("dot", 4, 103, "c.d")]
    texts = ["".join(rng.choice("abABcd(. ") for _ in range(rng.randrange(14))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    table = spark.createDataFrame(rules, "target string, priority int, ord int, pattern string")
    for block in (7, 1000):
        got = {r.k: r.target for r in automaton.routed(df, table, "text", block_rules=block).collect()}
        assert got == {k: None if t is None else plain_route(rules, t) for k, t in enumerate(texts)}
    assert {r.target for r in automaton.routed(df, table.limit(0), "text", "other").collect()} == {"other"}


def test_ten_thousand_rules(spark):
    table = spark.range(12_000).selectExpr("concat('agent', id) as target", "cast(id % 7 as int) as priority", "cast(id as int) as ord", "concat('keyword', id, '!') as pattern")
    texts = spark.range(0, 12_000, 5).selectExpr("id", "concat('needs KEYWORD', id, '! and keyword', id + 1, '! now') as text")
    rows = automaton.routed(texts, table, "text").collect()
    assert len(rows) == 2400
    for r in rows:
        assert r.target == f"agent{min((k for k in (r.id, r.id + 1) if k < 12_000), key=lambda k: (-(k % 7), k))}"


def test_pieces_that_expressions_need():
    found = {r"^order 107[05]*\b": "order 107", "ab?c+d": "a", r"a(bc)def[x]gh": "def", "a|b": "", r"(?x) a b": "", "ab{0,2}cde": "cde", r"\x41bcd": "", r"x\.yz": "yz", "A+B": "a", "[]ab]cd": "cd", "a{b": ""}
    assert {p: automaton.required(p) for p in found} == found


def test_letters_that_meet_ascii_case_aside(spark):
    rules = [("k", 5, 0, "^kel*in"), ("s", 4, 1, "s+t$"), ("plain", 3, 2, "mask"), ("i", 2, 3, "x+in")] + [(f"r{k}", 1, 10 + k, f"zz{k}") for k in range(20)]
    texts = ["Kelvin", "Kelin", "faſt", "masK", "xİn", "xıN", "ZZ1 zz19", "É", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    table = spark.createDataFrame(rules, "target string, priority int, ord int, pattern string")
    for block in (5, 1000):
        got = {r.text: r.target for r in automaton.routed(df, table, "text", block_rules=block).collect()}
        assert got == {t: plain_route(rules, t) for t in texts}


def test_long_tables_are_one_join(spark):
    table = spark.range(4000).selectExpr("concat('agent', id) as target", "1 as priority", "cast(id as int) as ord", "concat('keyword', id, '!') as pattern")
    texts = spark.range(40).selectExpr("concat('keyword', id, '!') as text")
    routed = automaton.routed(texts, table, "text", block_rules=10)
    assert routed._jdf.queryExecution().toString().count("MapInArrow") < 20
    assert {r.text[7:-1]: r.target[5:] for r in routed.collect()} == {str(k): str(k) for k in range(40)}


def test_lists_over_many_ranges(spark):
    """Lists of some words lie in many ranges: places go on from one to the next, and no task sorts more than its range."""
    notes = spark.range(0, 3000, 1, 5).selectExpr("(id * 7919) % 3000 as entry_id", "concat('common half', id % 2, ' own', id) as content")
    path = search.write_index(notes, most=500)
    index = spark.read.parquet(f"{path}/postings")
    sizes = [r["count"] for r in index.groupBy("range").count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 1000
    starts = spark.read.parquet(f"{path}/starts")
    assert starts.count() <= len(sizes)
    placed = index.join(starts, ["word", "range"], "left").selectExpr("word", "entry_id", "seat + coalesce(start, 0) as place").collect()
    common = sorted((r.place, r.entry_id) for r in placed if r.word == "common")
    assert common == [(k + 1, k) for k in range(3000)]
    queries = spark.createDataFrame([(1, "common"), (2, "common half1"), (3, "own5 half0 common")], "query_id long, text string")
    got = {(r.query_id, r.rank): (r.entry_id, r.hits) for r in search.search(spark, path, queries, 3).collect()}
    texts = {k * 7919 % 3000: {"common", f"half{k % 2}", f"own{k}"} for k in range(3000)}
    for q, words in ((1, {"common"}), (2, {"common", "half1"}), (3, {"own5", "half0", "common"})):
        want = sorted(texts, key=lambda i: (-len(texts[i] & words), i))[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, len(texts[i] & words)) for i in want]
