"""Counts over chunks against whole files; extensions called from SQL."""

import random

from sourceloom.functions.rules import FIRST_WORDS
from sourceloom.operators import chunked
from sourceloom.operators.extensions import Extensions, VariableRule
from sourceloom.operators.scanner import scan_files


def test_chunks_count_like_whole_files(spark):
    rng = random.Random(9)
    parts = ["EXEC SQL SELECT a", "exec  sql\n update t", "EXEC /* x */ SQL", " DELETE", "/* EXEC SQL INSERT\n */", "// EXEC SQL COMMIT\n", "-- EXEC SQL OPEN\n", ";\n", " EXEC SQL ", "x" * 30, "/", "*", "-", "\n", "EXEC", " SQL", "*/", "/*", "FETCH c;\n"]
    files = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(60)] + [(100, "y" * 500 + " EXEC SQL OPEN c;"), (101, ""), (102, None)]
    df = spark.createDataFrame(files, "file_id long, content string")
    index = {w: k for k, w in enumerate(FIRST_WORDS)}
    want = {}
    for k, text in files:
        counts = chunked._run(chunked._TOKEN.findall(text or ""), chunked.CODE, index)[1]
        want |= {(k, w): n for w, n in zip(FIRST_WORDS, counts) if n}
    assert sum(want.values()) > 100
    for options in ({}, {"size": 90, "overlap": 40, "near": 20}, {"size": 50, "overlap": 35, "near": 10}):
        got = chunked.chunk_counts(scan_files(df, "chunk", **options))
        assert {(r.file_id, r.keyword): r.n for r in got.collect()} == want, options
    every = {r.keyword: (r.n, r.files) for r in chunked.totals(chunked.chunk_counts(scan_files(df, "chunk"))).collect()}
    assert every == {w: (sum(n for (_, x), n in want.items() if x == w), sum(1 for _, x in want if x == w)) for w in {x for _, x in want}}


def test_extensions_from_sql(spark):
    held = Extensions()

    @held.scanner("todo_notes", "line long, note string")
    def notes(text):
        for k, line in enumerate(text.split("\n"), 1):
            if "TODO" in line:
                yield {"line": k, "note": line.split("TODO", 1)[1].strip()}

    @held.relationship("open_spans", "file_id long, name string, opened long, closed long")
    def spans(rows):
        opened = {}
        for r in rows:
            if r.kind == "open":
                opened[r.name] = r.line_start
            elif r.name in opened:
                yield {"file_id": r.file_id, "name": r.name, "opened": opened.pop(r.name), "closed": r.line_start}

    held.install(spark)
    spark.createDataFrame([(1, "a TODO one\nb\nTODO two"), (2, None), (3, "int f(void) { EXEC SQL COMMIT; }")], "file_id long, content string").createOrReplaceTempView("ext_files")
    assert [tuple(r) for r in spark.sql("SELECT file_id, n.* FROM ext_files, LATERAL todo_notes(content) AS n ORDER BY 1, 2").collect()] == [(1, 1, "one"), (1, 3, "two")]
    assert [r.raw for r in spark.sql("SELECT s.raw FROM ext_files, LATERAL scan_sql(content) AS s").collect()] == ["EXEC SQL COMMIT;"]
    spark.createDataFrame([(1, 30, "close", "c"), (1, 10, "open", "c"), (1, 20, "open", "d"), (2, 5, "close", "c"), (2, 6, "open", "c"), (2, 9, "close", "c")], "file_id long, line_start long, kind string, name string").createOrReplaceTempView("ext_stmts")
    rows = spark.sql("SELECT * FROM open_spans(TABLE(ext_stmts) PARTITION BY file_id ORDER BY line_start)").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "c", 10, 30), (2, "c", 6, 9)]
    assert held.unregister("todo_notes") and not held.unregister("todo_notes")


def test_variable_rules(spark):
    held = Extensions().variable_rule(VariableRule("plain", r":\w+", 10)).variable_rule(VariableRule("member", r":\w+\.\w+", 10)).variable_rule(VariableRule("dollar", r"\$\w+", 90)).variable_rule(VariableRule("odd", r":\w+", 20))
    df = spark.createDataFrame([(1, "a = :x AND b = :r.f + $y"), (2, None), (3, "none")], "k int, t string")
    assert {r.k: r.variables for r in held.variables(df, "t").collect()} == {1: ["odd=:x", "member=:r.f", "dollar=$y"], 2: None, 3: []}
