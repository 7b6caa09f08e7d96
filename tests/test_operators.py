"""Relationships, graphs, checks, sinks, sources and streams on small rows."""

import yaml
from pyspark.sql import functions as F

from sourceloom.operators import checks, graphs, relations
from sourceloom.sources import files, sinks
from sourceloom.streaming import statements as streams


def stmts(spark, rows):
    return spark.createDataFrame([("f", fn, line, kind, text) for fn, line, kind, text in rows], "file_id string, function string, line_start long, sql_type string, sql_text string")


def test_cursor_group(spark):
    rows = [("m", 10, "declare_cursor", "EXEC SQL DECLARE c1 CURSOR FOR SELECT a;"), ("m", 15, "open_cursor", "EXEC SQL OPEN c1;"), ("m", 16, "open_cursor", "EXEC SQL OPEN c10;"), ("m", 18, "fetch_into", "EXEC SQL FETCH c1 INTO :a;"), ("m", 22, "close_cursor", "EXEC SQL CLOSE c1;")]
    got = relations.cursor_groups(stmts(spark, rows)).collect()
    assert [(r.name, r.declare_line, r.open_line, r.close_line, r.fetches) for r in got] == [("c1", 10, 15, 22, 1)]


def test_dynamic_and_transaction(spark):
    rows = [("m", 30, "prepare", "EXEC SQL PREPARE s FROM :b;"), ("m", 32, "execute", "EXEC SQL EXECUTE s;"), ("m", 40, "insert", "EXEC SQL INSERT"), ("m", 45, "commit", "EXEC SQL COMMIT;"), ("m", 45, "update", "same line"), ("m", 50, "rollback", "EXEC SQL ROLLBACK;")]
    s = stmts(spark, rows)
    assert [(r.name, r.prepare_line, r.executions) for r in relations.dynamic_groups(s).collect()] == [("s", 30, 1)]
    closed = {r.line_start: r.boundary_line for r in relations.closing_boundary(s).collect()}
    assert closed == {30: 45, 32: 45, 40: 45, 45: 50}  # the first boundary on a later line
    ids = {r.boundary_line: (r.relationship_id, r.is_commit, r.statements) for r in relations.transactions(s).collect()}
    assert ids == {45: ("transaction_001", True, 3), 50: ("transaction_002", False, 1)}


def test_array_dml_and_write_back(spark):
    s = stmts(spark, [("m", 50, "insert", "EXEC SQL FOR :batch_size INSERT INTO t VALUES (:ids[i], :names[i]);"), ("m", 60, "declare_cursor", "EXEC SQL DECLARE c CURSOR FOR SELECT 1;")])
    r = relations.array_dml(s).collect()
    assert [(x.size_var, x.array_vars, x.dml) for x in r] == [(":batch_size", ["ids", "names"], "INSERT")]
    members = spark.createDataFrame([("f", 50, "txn_1", 2, 1, 1), ("f", 50, "array_1", 3, 1, 1)], "file_id string, line_start long, relationship_id string, plugin_order int, sequence int, total int")
    got = {x.line_start: x.relationship for x in relations.write_back(s, members).collect()}
    assert got[50].relationship_id == "array_1" and got[60] is None


def test_built_sql(spark):
    calls = [("f", "m", 1, "strcpy", "b", "SELECT * "), ("f", "m", 2, "strcat", "b", "FROM employees"), ("f", "m", 1, "sprintf", "c", None)]
    got = {r.target: (r.sql_text, r.confidence) for r in relations.built_sql(spark.createDataFrame(calls, "file_id string, function string, line_start int, name string, target string, value string")).collect()}
    assert got == {"b": ("SELECT * FROM employees", 0.9), "c": ("?", 0.85)}


def test_docstrings_macros_and_gaps(spark):
    fns = spark.createDataFrame([("f", "g", 10)], "file_id string, name string, line_start int")
    notes = spark.createDataFrame([("f", 1, 1, "far"), ("f", 6, 6, "a"), ("f", 8, 8, "b")], "file_id string, line_start int, line_end int, raw string")
    assert relations.docstrings(fns, notes).collect()[0].docstring == "a\nb"
    v = spark.createDataFrame([("f", ["N", "3", None])], "file_id string, array_sizes array<string>")
    m = spark.createDataFrame([("f", "N", "10")], "file_id string, name string, value string")
    assert relations.macro_sizes(v, m).collect()[0].resolved_array_sizes == ["10", "3", None]
    lines = spark.createDataFrame([("f", k) for k in range(1, 11)], "file_id string, line_no int")
    spans = spark.createDataFrame([("f", 2, 3), ("f", 3, 5), ("f", 9, 9)], "file_id string, line_start int, line_end int")
    assert sorted((r.line_start, r.line_end) for r in relations.uncovered(lines, spans).collect()) == [(1, 1), (6, 8), (10, 10)]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graphs.closure(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.node, r.depth) for r in graphs.call_chains(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    left = spark.createDataFrame([(1, "H_user_name"), (2, "ID"), (3, "same")], "id int, name string")
    right = spark.createDataFrame([(7, "userName"), (8, "id"), (9, "same")], "id int, name string")
    got = {(r.source_id, r.target_id): (r.confidence, r.rule) for r in graphs.name_links(left, right, "USED_IN").collect()}
    assert got == {(1, 7): (0.9, "stripped_camel"), (2, 8): (0.95, "lower"), (3, 9): (1.0, "exact")}
    a = spark.createDataFrame([("1", "old"), ("2", "x")], "id string, name string")
    b = spark.createDataFrame([("1", "new")], "id string, name string")
    nodes, both = graphs.merged((a, edges), (b, edges))
    assert {(r.id, r.name) for r in nodes.collect()} == {("1", "new"), ("2", "x")} and both.count() == 8
    inc = spark.createDataFrame([("d", "a.h"), ("d", "no.h")], "source_dir string, name string")
    have = spark.createDataFrame([("inc/a.h",), ("d/z.h",)], "path string")
    assert {r.name: r.path for r in graphs.resolved_includes(inc, have, ["lib", "inc"]).collect()} == {"a.h": "inc/a.h", "no.h": None}
    flow = graphs.word_edges(spark.createDataFrame([("f", "t", "a + bb*2")], "file_id string, target string, expression string"), spark.createDataFrame([("f", "bb"), ("f", "b")], "file_id string, name string"))
    assert [(r.source, r.target) for r in flow.collect()] == [("bb", "t")]


def test_similar_issues(spark):
    import itertools
    import random

    rng = random.Random(4)
    texts = {k: " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 8))) + " the" * (k % 2) for k in range(60)}
    sets = {k: set(t.split()) for k, t in texts.items()}
    want = {(a, b): len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) for a, b in itertools.combinations(texts, 2) if sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) > min(len(sets[a]), len(sets[b]))}
    got = {(r.a, r.b): r.overlap for r in graphs.similar_issues(spark.createDataFrame(list(texts.items()), "id int, text string")).collect()}
    assert want and got == want


def test_checks_and_reports(spark):
    pairs = spark.createDataFrame([("x", 0, "EXEC SQL SELECT a INTO :h FROM t WHERE b = :v;", "SELECT a FROM t WHERE b = #{v}"), ("x", 1, "EXEC SQL SELECT a FROM t;", "EXEC SQL SELECT a FROM t WHERE c = :v;")], "file string, idx int, sql string, parsed_sql string")
    long = {(r.idx, r.check): r.status for r in checks.conversion_checks(pairs).collect()}
    assert {s for (i, _), s in long.items() if i == 0} == {"pass"}
    assert long[1, "exec_sql_removed"] == "fail" and long[1, "host_vars_converted"] == "fail" and long[1, "semicolon_removed"] == "warning"
    totals = checks.check_totals(checks.conversion_checks(pairs))
    assert {(r.file, r.n_fail) for r in totals.collect()} == {("x", 2), (None, 2)}
    assert [r.value for r in sinks.markdown_report(totals).orderBy("ord").collect()][-1].startswith("| all |")
    same = checks.token_diffs(spark.createDataFrame([("a b c", "a x c")], "sql string, parsed_sql string")).collect()[0]
    assert (same.similarity, same.replaced) == (0.666667, 1)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.pc").write_bytes(b"EXEC SQL COMMIT; \xff")
    (tmp_path / "src/b.txt").write_text("no")
    assert [r.file_id.rsplit("/", 1)[1] for r in files.source_files(spark, str(tmp_path / "src")).collect()] == ["a.pc"]
    (tmp_path / "p.yaml").write_text(yaml.safe_dump([{"sql": " a ", "parsed_sql": "b", "k": 1}, {"sql": "x"}, "no"]))
    got = files.conversion_pairs(spark, str(tmp_path)).collect()
    assert [(r.idx, r.sql, r.parsed_sql, r.metadata) for r in got] == [(0, "a", "b", {"k": "1"})]
    sinks.write_elements(spark.createDataFrame([("sql", "s"), ("include", "i")], "type string, raw string"), str(tmp_path / "out"))
    assert {r.type for r in spark.read.json(str(tmp_path / "out")).collect()} == {"sql", "include"}
    nodes = spark.createDataFrame([("1", "a'b", "T")], "id string, name string, node_type string")
    links = spark.createDataFrame([("1", "1", "IN", "E")], "source_id string, target_id string, link_type string, edge_type string")
    assert sinks.cypher_statements(nodes, links, merge=True).first().value == "MERGE (n:T {id: '1'}) SET n.name = 'a\\'b';"
    assert sinks.dot_lines(nodes, links).count() == 4 and sinks.graph_records(nodes, links).count() == 2
    fields = spark.createDataFrame([("rec_t", 0, "cust_nm", "char", 9, 0, None), ("rec_t", 1, "amt", "double", 13, 2, "money")], "struct_name string, ordinal int, name string, dtype string, size int, decimal int, description string")
    assert sinks.omm_texts(fields).first().text == 'OMM Rec\r\n{\r\n\tString custNm<length=9 description="cust_nm">;\r\n\tBigDecimal amt<length=13 decimal=2 description="money">;\r\n}\r\n'


def test_streams(spark, tmp_path, sf_dir):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pc").write_text("EXEC SQL OPEN c1;\nEXEC SQL COMMIT;")
    q = streams.arriving_statements(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert {r.sql_type for r in spark.sql("select * from arrived").collect()} == {"open_cursor", "commit"}
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    q = streams.windowed_counts(events).writeStream.outputMode("update").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counted").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
