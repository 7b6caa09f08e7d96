"""Contexts, text operators and Java merging on small rows."""

from pyspark.sql import functions as F

from sourceloom.functions import text
from sourceloom.operators import context, java


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).collect()[0].x


def test_text_operators(spark):
    c = F.col("t")
    assert one(spark, text.split_arguments(c), "buf, \"a,b\", f(1, 2), 'x,y'") == ["buf", '"a,b"', "f(1, 2)", "'x,y'"]
    assert one(spark, text.in_literal(c), "a = 'x") is True
    assert one(spark, text.restored_times(text.protected_times(c)), "TO_CHAR(d, 'HH24:MI') = :x") == "TO_CHAR(d, 'HH24:MI') = :x"
    assert ":" not in one(spark, text.protected_times(c), "TO_CHAR(d, 'HH24:MI')")
    assert one(spark, text.returning_aliases(c), "INSERT INTO t VALUES (1) RETURNING id, nm INTO :new_id, :nm") == "INSERT INTO t VALUES (1) RETURNING id AS newId, nm AS nm"
    assert one(spark, text.macro_calls(c), "BAMCALL(a, b); BAMCALL (c);") == ["a, b", "c"]
    files = spark.createDataFrame([("f", "ab EXEC cd EXEC ef"), ("g", "x\ny\nz")], "file_id string, content string")
    blocks = spark.createDataFrame([("f", 3, 7, "<1>"), ("f", 11, 15, "<2>")], "file_id string, start long, end long, marker string")
    assert {r.file_id: r.content for r in text.spliced(files, blocks).collect()} == {"f": "ab <1> cd <2> ef", "g": "x\ny\nz"}
    assert [(r.line_no, r.line) for r in text.line_slice(files.where("file_id = 'g'"), 2, 3).collect()] == [(2, "y"), (3, "z")]


def test_contexts(spark):
    fields = spark.createDataFrame([("s", "rec", 5), ("s", "rec_cnt", None), ("s", "z", 2)], "struct_name string, name string, array_size int")
    assert {r.name: r.count_field for r in context.count_fields(fields).collect()} == {"rec": "rec_cnt", "z": None}
    v = spark.createDataFrame([("H_user_id",), ("w_user_id",), ("x",)], "name string")
    assert {r.java_name: r.source_names for r in context.java_names(v, ("H_", "w_")).collect()} == {"userId": ["H_user_id", "w_user_id"], "x": ["x"]}
    a = spark.createDataFrame([("f", "a = b = c")], "file_id string, statement string")
    assert [(r.target, r.source) for r in context.chain_edges(a).collect()] == [("a", "b"), ("b", "c")]
    code = spark.createDataFrame([("f", "p->x = 1; if (q.y == 2) r.z;")], "file_id string, content string")
    assert [(r.struct, r.field, r.access, r.is_pointer) for r in context.field_accesses(code).collect()] == [("p", "x", "write", True), ("q", "y", "read", False), ("r", "z", "read", False)]
    m = spark.createDataFrame([("N", "1", 0), ("N", "2", 1), ("S", "x", 0)], "name string, value string, file_ord int")
    assert {(r.name, r.value) for r in context.latest_macros(m, numeric=True).collect()} == {("N", "2")}
    notes = spark.createDataFrame([(1, "fix the cursor", ["a", "b"]), (2, "other", ["a"])], "entry_id long, content string, tags array<string>")
    assert [(r.entry_id, r.score) for r in context.searched(notes, "Cursor fix now").collect()] == [(1, 2 / 3)]
    assert {(r.tag, r.n) for r in context.tag_counts(notes).collect()} == {("a", 2), ("b", 1)}
    fns = spark.createDataFrame([("f", "m", 1, 9)], "file_id string, name string, line_start int, line_end int")
    part = lambda rows, cols: spark.createDataFrame(rows, "file_id string, function string, " + cols)
    ctx = context.function_contexts(fns, part([("f", "m", "x", "int")], "name string, data_type string"), part([("f", "m", 3, "commit")], "line_start int, sql_type string"), part([], "name string"))
    assert ctx.first().summary == "m: 1 variables, 1 statements, 0 calls" and "- 3 commit" in context.prompt_text(ctx).first().text


SKELETON = "package p;\nimport java.util.List;\npublic class A {\n    int x;\n}\n"


def test_java_merge(spark):
    answers = ["```java\nimport org.z.Q;\nimport java.io.File;\npublic int go(int a) {\n  String s = \"}\"; // }\n  return 1;\n}\n```", "public int go(int a) { return 2; }\nprivate void other() { }"]
    rows = [("A", SKELETON, a, k) for k, a in enumerate(answers)]
    out = java.merge_classes(spark.createDataFrame(rows, "class_id string, skeleton string, llm_response string, ord int"), "protected").first().text
    assert out.index("import java.io.File;") < out.index("import java.util.List;") < out.index("import org.z.Q;")
    assert out.count("go(int a)") == 1 and "return 2" in out and "protected void other()" in out and out.rstrip().endswith("}")
