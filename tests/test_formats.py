"""Own formats: readers with failing files, writers that leave all or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from sourceloom.operators.scanner import scan_files
from sourceloom.sources import files, formats, sinks


@pytest.fixture
def tree(tmp_path):
    def write(**named):
        for name, content in named.items():
            place = tmp_path / "in" / name.replace("__", "/").replace("_DOT_", ".")
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(tmp_path / "in")

    return write


def test_pairs_and_checklists(spark, tree):
    formats.register(spark)
    path = tree(
        a_DOT_yaml="- sql: |\n    SELECT 1;\n  parsed_sql: SELECT 1\n  note: 5\n- sql: only\n- text\n- {sql: x, parsed_sql: y}\n",
        deep__b_DOT_yml="sql: one\nparsed_sql: two\n",
        broken_DOT_yaml="- sql: [unclosed\n",
        bytes_DOT_yaml=b"\xff\xfe",
        empty_DOT_yaml="",
        c_DOT_yaml="checks:\n  sql:\n    llm_checks:\n      - name: first\n        check: 'is it: right?'\n      - plain, with comma\n      - {weight: 3}\nllm_checks: {k: v}\n",
    )
    rows = spark.read.format("conversion_pairs").load(path).collect()
    name = lambda r: os.path.basename(r.path)
    assert {(name(r), r.idx, r.sql, r.parsed_sql, tuple((r.metadata or {}).items())) for r in rows if not r.error} == {("a.yaml", 0, "SELECT 1;", "SELECT 1", (("note", "5"),)), ("a.yaml", 3, "x", "y", ()), ("b.yml", 0, "one", "two", ())}
    assert {name(r) for r in rows if r.error} == {"broken.yaml", "bytes.yaml"} and all(r.sql is None for r in rows if r.error)
    shallow = spark.read.format("conversion_pairs").option("recursive", "false").load(path).where("error is null")
    assert {name(r) for r in shallow.collect()} == {"a.yaml"}
    checks = spark.read.format("yaml_checklist").option("key", "checks.sql.llm_checks").load(f"{path}/c.yaml").collect()
    assert [(r.ordinal, r["name"], r.item) for r in checks] == [(0, "first", "is it: right?"), (1, None, "plain, with comma"), (2, None, "weight: 3")]
    assert [(r["name"], r.item) for r in spark.read.format("yaml_checklist").load(f"{path}/c.yaml").collect()] == [("k", "v")]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("conversion_pairs").load(f"{path}/nowhere").collect()


def test_source_trees(spark, tree):
    formats.register(spark)
    path = tree(x_DOT_pc="int a; /* é */", sub__y_DOT_h=b"char \xe9;", z_DOT_txt="no")
    rows = {os.path.basename(r.path): r for r in spark.read.format("source_tree").load(path).collect()}
    assert rows["x.pc"].content == "int a; /* é */" and rows["y.h"].content == "char �;" and set(rows) == {"x.pc", "y.h"}
    strict = {os.path.basename(r.path): r for r in spark.read.format("source_tree").option("strict", "true").load(path).collect()}
    assert strict["x.pc"].error is None and strict["y.h"].content is None and "UnicodeDecodeError" in strict["y.h"].error


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.startswith("."))


def test_texts_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("text é\r\n"), "id").alias("content")).repartition(5)
    sinks.write_texts(rows, path)
    back = {r.path.split("/out/")[1]: r.content for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").cast("string").alias("content")).collect()}
    assert back == {r.name: r.content for r in rows.collect()}
    with pytest.raises(Exception, match="already"):
        sinks.write_texts(rows.limit(1), path)
    sinks.write_texts(spark.createDataFrame([("d0/f0.txt", None)], "name string, content string"), path, overwrite=True)
    assert len(names(path)) == 40 and os.path.getsize(f"{path}/d0/f0.txt") == 0
    failing = rows.withColumn("content", F.when(F.col("name") == "d1/f37.txt", F.raise_error(F.lit("stop here"))).otherwise(F.col("content"))).withColumn("name", F.concat(F.lit("new/"), "name"))
    with pytest.raises(Exception, match="stop here"):
        sinks.write_texts(failing, path)
    twice = spark.createDataFrame([("one", "a"), ("./one", "b")], "name string, content string")
    with pytest.raises(Exception, match="twice"):
        sinks.write_texts(twice, path)
    with pytest.raises(Exception, match="no file name"):
        sinks.write_texts(spark.createDataFrame([("../up", "a")], "name string, content string"), path)
    assert len(names(path)) == 40 and not os.path.exists(tmp_path / "up")


def test_every_writer_reads_back(spark, tmp_path):
    out = str(tmp_path)
    text = "EXEC SQL BEGIN DECLARE SECTION;\nint a;\nEXEC SQL END DECLARE SECTION;\nEXEC SQL SELECT b FROM t;\n"
    source = spark.createDataFrame([("p.pc", text)], "file_id string, content string")
    sinks.write_sections(scan_files(source, "section"), f"{out}/s")
    assert open(f"{out}/s/p.pc/declare_section_0.c").read() == "int a;"
    blocks = scan_files(source, "sql").withColumn("marker", F.concat(F.lit("/* sql "), "seq", F.lit(" */")))
    sinks.write_marked(source, blocks, f"{out}/m")
    assert open(f"{out}/m/p.pc").read() == "/* sql 0 */\nint a;\n/* sql 1 */\n/* sql 2 */\n"
    stmts = spark.createDataFrame([("p.pc", 1, "sql_001", "select", "select_0", "select", "SELECT a\nFROM t WHERE x < 1")], "file_id string, line_start int, sql_id string, sql_type string, sql_name string, tag string, sql_text string").withColumn("sql", F.col("sql_text"))
    sinks.write_sql_calls(stmts, f"{out}/y")
    import yaml

    assert yaml.safe_load(open(f"{out}/y/p.pc/sql_calls.yaml")) == {"sql_calls": [{"sql_id": "sql_001", "sql_type": "select", "sql": "SELECT a\nFROM t WHERE x < 1\n"}]}
    sinks.write_mappers(stmts, "ns", "now", f"{out}/x")
    assert "x &lt; 1" in open(f"{out}/x/p.pc.xml", newline="").read()
    fields = spark.createDataFrame([("rec_t", 0, "a_b", "int", 4, 0, None)], "struct_name string, ordinal int, name string, dtype string, size int, decimal int, description string")
    sinks.write_descriptors(fields, f"{out}/o")
    assert open(f"{out}/o/Rec.omm", newline="").read() == 'OMM Rec\r\n{\r\n\tInteger aB<length=4 description="a_b">;\r\n}\r\n'
    items = spark.createDataFrame([("q/r.yaml", 0, "SELECT a\n  FROM t: x", "b # c", "approved", 'he said: "no"\\'), ("q/r.yaml", 1, "x", "y", None, None)], "file string, idx int, sql string, parsed_sql string, status string, comment string")
    sinks.write_items(items, f"{out}/i")
    formats.register(spark)
    back = {r.idx: (r.sql, r.parsed_sql, r.metadata) for r in spark.read.format("conversion_pairs").load(f"{out}/i").collect()}
    assert back == {0: ("SELECT a\n  FROM t: x", "b # c", {"idx": "0", "status": "approved", "comment": 'he said: "no"\\'}), 1: ("x", "y", {"idx": "1"})}
    sinks.write_session(items, f"{out}/j")
    assert {(r.idx, r.status, r.comment) for r in files.session_items(spark, f"{out}/j").collect()} == {(0, "approved", 'he said: "no"\\')}
