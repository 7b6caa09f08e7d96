"""Checks, stage registry, readers and text outputs on small rows."""

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import builds, relations
from sourceloom.operators.scanner import c_elements, declare_sections, normalized_tokens
from sourceloom.sources import files, sinks


def test_struct_and_class_checks(spark):
    texts = spark.createDataFrame([(1, "typedef struct a { int x; } a_t; struct b {int y;};"), (2, "int z;")], "file_id long, content string")
    found = spark.createDataFrame([(1, "a_t")], "file_id long, name string")
    assert {(r.file_id, r.in_text, r.extracted) for r in builds.struct_checks(texts, found).collect()} == {(1, 2, 1), (2, 0, 0)}
    classes = spark.createDataFrame([("public class Order {", "Order"), ("class Orders {}", "Order"), (None, "x")], "text string, name string")
    assert [r.has_class for r in builds.class_checks(classes, F.col("name")).collect()] == [True, False, None]


def test_stages_run_by_phase_and_are_replaced_by_name(spark):
    v = builds.Verifier(builds.Stage("b", "post", None), builds.Stage("a", "pre", lambda d: F.lit("PASS")))
    v.register(builds.Stage("b", "verify", lambda d: F.lit("FAIL"), message=lambda d: F.col("t")))
    rows = v.run(spark.createDataFrame([("x",)], "t string")).collect()
    assert [(r.phase, r.ordinal, r["check"], r.status, r.message) for r in rows] == [("pre", 0, "a", "PASS", ""), ("verify", 1, "b", "FAIL", "x")]
    with pytest.raises(ValueError):
        v.register(builds.Stage("c", "later", None))


def test_prompts_front_matter_and_checklists(spark):
    rows = spark.createDataFrame([("a", "old {asis} new {tobe}"), ("b", "only {asis}"), ("c", "---\nname: one\ntools: \"x, y\"\n---\nbody\nline")], "path string, content string")
    kept = files.prompts(rows)
    assert [r.x for r in kept.select(files.filled(F.col("content"), F.lit("1"), F.lit("2")).alias("x")).collect()] == ["old 1 new 2"]
    front = {r.path: r for r in files.with_front_matter(rows).collect()}
    assert front["c"].meta == {"name": "one", "tools": "x, y"} and front["c"].body == "body\nline" and front["a"].meta == {} and front["a"].body == rows.first().content
    listed = spark.createDataFrame([("l", "name: x\nllm_checks:\n  - first one\n  - 'second'\nother:\n  - third\n")], "path string, content string")
    assert [(r.ordinal, r.item) for r in files.checklists(listed).collect()] == [(0, "first one"), (1, "second")]


def test_records_report_and_store(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1,\n "note": "x"}')
    assert [tuple(r) for r in files.json_records(spark, str(tmp_path), "id long, note string").collect()] == [(1, "x")]
    html = sinks.report_html(spark.createDataFrame([("b", "fail", "1 < 2"), ("a", "pass", "")], "name string, status string, message string"), "T").first().html
    assert html.index("<td>a</td>") < html.index("<td>b</td>") and "1 &lt; 2" in html
    assert sinks.store_schema(("File",)) == ["CREATE CONSTRAINT IF NOT EXISTS FOR (n:File) REQUIRE n.id IS UNIQUE;", "CREATE INDEX IF NOT EXISTS FOR (n:File) ON (n.name);"]


def test_scopes_outside_and_in_files_without_spans(spark):
    variables = spark.createDataFrame([(1, 5, "static int a;"), (2, 1, "int b;")], "file_id long, line_start long, raw string")
    spans = spark.createDataFrame([], "file_id long, line_start long, line_end long")
    assert {(r.file_id, r.scope) for r in relations.declared_scope(variables, spans, spans).collect()} == {(1, "static"), (2, "global")}


def test_tokens_times_strings_and_indicators():
    one = lambda t, **k: next(normalized_tokens(t, **k))
    got = one("EXEC SQL SELECT a, ':no', 10:20 INTO :x:i, :y FROM t /* c */ WHERE b = :r.f AND c = :v[1];")
    assert got == {"sql": "SELECT a, ':no', 10:20 FROM t /* c */ WHERE b = ? AND c = ?", "inputs": [":r.f", ":v[1]"], "outputs": [":x", ":i", ":y"]}
    assert one("EXEC SQL FOR :n INSERT INTO t VALUES (:a_b)", alias=str.upper) == {"sql": "INSERT INTO t VALUES (:a_b AS A_B)", "inputs": [":n", ":a_b"], "outputs": []}


def test_sections_that_never_end_and_many_blocks():
    assert list(declare_sections("EXEC SQL BEGIN DECLARE SECTION;\nint a;")) == []
    text = "int f(void) {\n" + "EXEC SQL SELECT a FROM g(1);\n" * 20_000 + "}\n"
    assert [(e["kind"], e["line_end"]) for e in c_elements(text)] == [("function", 20_002)]
