"""Merge plugins, prompt forms, listings and trees, names and counters."""

import pathlib

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import rewrite as rw
from sourceloom.functions import rules
from sourceloom.operators import context, java, relations
from sourceloom.sources import files


def test_merge_plugins(spark):
    held = java.MergePlugins(java.single_main(), java.with_annotation("@Category"), java.with_visibility("public"), java.MergePlugin("shout", "class", lambda t: t.replace("class A", "class B"), 10))
    with pytest.raises(ValueError, match="visibility"):
        held.register(java.with_visibility("private"))
    assert [p.name for p in held.of("method")] == ["visibility", "category"] and [p.name for p in held.of("class")] == ["shout", "main_deduplicator"]
    rows = [("c", "package p;\npublic class A {\n    public static void main(String[] a) { }\n}\n", "```java\nimport java.util.List;\nprivate int f(int x) { return x; }\n@Category\nint g() { return 1; }\n```", 1), ("c", "package p;\npublic class A {\n}\n", "int f(int x) { return 2; }\nstatic void runMain() { }", 2)]
    text = java.merge_with(spark.createDataFrame(rows, "class_id string, skeleton string, llm_response string, ord int"), held).first().text
    assert "import java.util.List;" in text and "class B" in text
    assert text.count("public int f(int x)") == 2
    assert text.count("@Category") == 4 and "@Category\npublic int g()" in text and "main(" not in text and "runMain" in text
    only = java.merge_with(spark.createDataFrame(rows, "class_id string, skeleton string, llm_response string, ord int"), held, ["category", "unknown"]).first().text
    assert "private int f" in only and "class A" in only and "main(" in only and only.count("@Category") == 4


def test_prompt_forms(spark):
    row = [(1, "f", 3, 9, "sum", [("a<b", "int"), ("c", None)], [(4, "select"), (6, "commit")], [("g",)]), (2, "h", 1, 1, "s", None, None, None)]
    schema = "file_id long, function string, line_start long, line_end long, summary string, variables array<struct<name: string, data_type: string>>, statements array<struct<line_start: bigint, sql_type: string>>, calls array<struct<name: string>>"
    df = spark.createDataFrame(row, schema)
    text = lambda form, **k: {r.file_id: r.text for r in context.prompt_text(df, form, **k).collect()}
    assert text("markdown") == {1: "## f\nsum\n- 4 select\n- 6 commit", 2: "## h\ns\n"}
    assert text("compact") == {1: "[FUNC]f 3-9\n[VARS]int a<b;c\n[SQL:select]4\n[SQL:commit]6\n[CALLS]g", 2: "[FUNC]h 1-1"}
    import xml.etree.ElementTree as ET

    xml = text("xml", most=1)
    first = ET.fromstring(xml[1])
    assert [v.attrib for v in first.find("variables")] == [{"type": "int", "name": "a<b"}] and [s.attrib for s in first.find("statements")] == [{"line": "4", "type": "select"}, {"line": "6", "type": "commit"}]
    assert ET.fromstring(xml[2]).attrib == {"name": "h", "from": "1", "to": "1"} and len(ET.fromstring(xml[2])) == 0
    with pytest.raises(ValueError):
        context.prompt_text(df, "other")


PATHS = ["b.txt", "A/z.c", "A/inner/deep/x.h", "A/inner/y.h", "a2/q.c", ".git/config", "A/.hid", "README"]


def test_glob_and_tree(spark, tmp_path):
    for p in PATHS:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * len(p))
    listed = files.listing(spark, str(tmp_path)).select("path", "length")
    for pattern in ("**/*.h", "*.c", "A/*", "A/**/*.h", "**/?.[ch]", "b.txt"):  # Spark lists no hidden files
        want = {str(p) for p in tmp_path.glob(pattern) if p.is_file() and not any(x.startswith(".") for x in p.parts)}
        assert want == {r.path for r in files.globbed(listed.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), f"{tmp_path}/{pattern}").collect()}, pattern
    assert {r.path for r in files.globbed(spark.createDataFrame([("a/b/c.h",), ("c.h",), ("c.hpp",)], "path string"), "c.h").collect()} == {"a/b/c.h", "c.h"}
    rest = spark.createDataFrame([(p, len(p)) for p in PATHS], "path string, length long")

    def plain(folder, lead="", level=1, depth=99, hidden=False, only=False):
        found = sorted((p for p in folder.iterdir() if (hidden or not p.name.startswith(".")) and (p.is_dir() or not only)), key=lambda p: (not p.is_dir(), p.name.lower(), p.name))
        for p in found if level <= depth else ():
            last = p == found[-1]
            yield lead + ("└── " if last else "├── ") + (f"{p.name}/" if p.is_dir() else f"{p.name} ({p.stat().st_size} bytes)")
            if p.is_dir():
                yield from plain(p, lead + ("    " if last else "│   "), level + 1, depth, hidden, only)

    for options, same in (({}, {}), ({"depth": 2}, {"depth": 2}), ({"hidden": True}, {"hidden": True}), ({"folders_only": True}, {"only": True})):
        assert [r.line for r in files.tree(rest, **options).orderBy("at").collect()] == list(plain(pathlib.Path(tmp_path), **same)), options


def test_names_and_ids(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first().x
    t = F.col("t")
    assert [one(rw.host_name(t, keep, upper), ":user_id2:ind") for keep in (False, True) for upper in (False, True)] == ["userId2", "UserId2", "user_id2", "User_id2"]
    assert one(rw.host_names(F.split(t, ",")), ":a_b,:c[1],:a_b:i,:r.f") == ["aB", "c", "r"]
    long = ["x" * 60 + s for s in "ab"]
    ids = [one(rw.safe_id(t), x) for x in [*long, "a::b c", "9lives"]]
    assert ids[2:] == ["a__b_c", "_9lives"] and len(set(ids[:2])) == 2 and all(len(i) == 50 for i in ids[:2])
    rows = [(1, 10, "select"), (1, 20, "insert"), (1, 30, "select"), (2, 5, "select")]
    stmts = spark.createDataFrame(rows, "file_id int, line_start int, sql_type string")
    counters = relations.next_ids(stmts)
    assert {(r.file_id, r.sql_type, r.next) for r in counters.collect()} == {(1, "select", 2), (1, "insert", 1), (1, None, 4), (2, "select", 1), (2, None, 2)}
    more = {(r.file_id, r.line_start): (r.sql_id, r.sql_name) for r in relations.statement_ids(stmts, counters).collect()}
    assert more == {(1, 10): ("sql_004", "select_2"), (1, 20): ("sql_005", "insert_1"), (1, 30): ("sql_006", "select_3"), (2, 5): ("sql_002", "select_1")}
    assert one(rules.header_type(F.lit("#define A 1\n"), t), "inc/stdio.h") == "system" and one(rules.header_type(F.lit("#define A 1\n"), t), "inc/mine.h") == "macro"
    seq = spark.createDataFrame([(1, 5, 1), (1, 5, 0), (1, None, 0), (1, 2, 9)], "file_id int, line_start int, seq int")
    assert {(r.line_start, r.seq): r.position for r in context.in_order(seq).collect()} == {(2, 9): 1, (5, 0): 2, (5, 1): 3, (None, 0): 4}
