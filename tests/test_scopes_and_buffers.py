"""Scopes by sweeps against all pairs, docstrings, and SQL built in buffers."""

import random
import time

from pyspark.sql import functions as F

from sourceloom.operators import dynamic, relations
from sourceloom.operators.scanner import scan_files


def spans(rng, n, nested):
    out = []
    for k in range(n):
        s = rng.randrange(60)
        e = s + rng.randrange(25)
        if not nested or all(x[0] != s and (e < x[0] or s > x[1] or (x[0] < s and e < x[1]) or (s < x[0] and x[1] < e)) for x in out):
            out.append((s, e, f"f{k}"))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(4)
    fns, elements = [], []
    for file in range(40):
        fns += [(file, *x) for x in spans(rng, rng.randrange(12), file % 2 == 0)]
        for k in range(25):
            s = None if rng.random() < 0.05 else rng.randrange(70)
            e = None if rng.random() < 0.2 or s is None else s + rng.randrange(6)
            elements.append((file, s, e, k, "old"))
    f = spark.createDataFrame(fns, "file_id long, line_start long, line_end long, name string")
    e = spark.createDataFrame(elements, "file_id long, line_start long, line_end long, k int, function string")
    for innermost in (False, True):
        for start_only in (False, True):
            got = {(r.file_id, r.k): r.function for r in relations.scoped(e, f, start_only=start_only, innermost=innermost).collect()}
            assert len(got) == len(elements)
            for file, s, end, k, _ in elements:
                y = s if end is None or start_only else end
                inside = [] if s is None else [(a, b, n) for i, a, b, n in fns if i == file and a <= s and b >= y]
                if innermost:
                    top = max((a for a, _, _ in inside), default=None)
                    want = {n for a, b, n in inside if a == top and b == min(y for x, y, _ in inside if x == top)} or {None}
                else:
                    want = {n for a, b, n in inside if (a, b) == min(x[:2] for x in inside)} or {None}
                assert got[file, k] in want, (file, s, end, k, inside)
    assert {(r.file_id, r.k) for r in relations.inside_spans(e, f).collect()} == {(i, k) for i, s, _, k, _ in elements if s is not None and any(j == i and a <= s <= b for j, a, b, _ in fns)}


def test_many_statements_and_functions_in_one_file(spark):
    elements = spark.range(400_000).select(F.lit(1).alias("file_id"), F.col("id").alias("line_start"), F.col("id").alias("line_end"))
    functions = spark.range(10_000).select(F.lit(1).alias("file_id"), (F.col("id") * 40).alias("line_start"), (F.col("id") * 40 + 29).alias("line_end"), F.concat(F.lit("f"), "id").alias("name"))
    began = time.time()
    for innermost in (False, True):
        found = relations.scoped(elements, functions, innermost=innermost)
        assert found.where(F.col("function") == F.concat(F.lit("f"), F.floor(F.col("line_start") / 40))).count() == 300_000
    assert time.time() - began < 120  # all pairs are 4,000,000,000


def test_docstrings(spark):
    functions = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (1, "a", 30), (2, "c", 1)], "file_id long, name string, line_start long")
    notes = spark.createDataFrame([(1, 5, 6, "x"), (1, 7, 8, "y"), (1, 12, 13, "z"), (1, 28, 28, "w"), (1, 33, 33, "below")], "file_id long, line_start long, line_end long, raw string")
    assert {(r.file_id, r.line_start): r.docstring for r in relations.docstrings(functions, notes).collect()} == {(1, 10): "x\ny", (1, 20): None, (1, 30): "w", (2, 1): None}


SOURCE = """
void plain() {
    strcpy(sql_stmt, "SELECT * ");
    strcat(sql_stmt, "FROM employees");
    EXEC SQL PREPARE s FROM :sql_stmt;
    sprintf(sql_stmt, "DELETE FROM %s WHERE id = %d AND n = '%-4s|%5.2s' AND p = %s%%", tab, 010, "ab", "xyz", other);
    EXEC SQL PREPARE s2 FROM :sql_stmt;
    EXEC SQL PREPARE s3 FROM :never;
}
void tracked() {
    strcpy(tab, "depart" "ments");
    snprintf((char *)buf, sizeof(buf), "SELECT \\"q\\", f(a, %s) FROM %s", "b, c", tab);
    strncat(buf, " WHERE x = 1 AND more", 12); EXEC SQL PREPARE s4 FROM :buf;
    strncpy(buf, "UPDATE t SET a = 1",
       8);
    strcat(buf, tail(1, 2));
    EXEC SQL PREPARE s5 FROM :buf;
    memcpy(buf, "no", 2);
    EXEC SQL EXECUTE s5;
}
"""


def test_built_sql(spark):
    files = spark.createDataFrame([(1, SOURCE), (2, None)], "file_id long, content string")
    c = scan_files(files, "c")
    calls = c.where("kind = 'function_call'").withColumn("function", F.col("parent"))
    blocks = relations.scoped(scan_files(files, "sql"), c.where("kind = 'function'")).withColumn("sql_text", F.col("raw"))
    rows = {r.name: r for r in dynamic.prepared_sql(calls, blocks).collect()}
    assert {k: (r.function, r.buffer, r.sql_text, r.confidence) for k, r in rows.items()} == {
        "s": ("plain", "sql_stmt", "SELECT * FROM employees", 0.9),
        "s2": ("plain", "sql_stmt", "DELETE FROM ? WHERE id = 10 AND n = 'ab  |   xy' AND p = ?%", 0.75),
        "s3": ("plain", "never", None, 0.0),
        "s4": ("tracked", "buf", 'SELECT "q", f(a, b, c) FROM departments', 0.9),
        "s5": ("tracked", "buf", "UPDATE t?", 0.65),
    }
    assert rows["s"].operations == ['strcpy(sql_stmt, "SELECT * ")', 'strcat(sql_stmt, "FROM employees")']


def test_formats():
    assert dynamic.formatted("%05d|%x|%s|%c|%f|%*d|%ld|%%", ["42", "255", '"a"', "'z'", "1.5", "3", "7", "8L"], {}) == "00042|ff|a|z|?|?|8|%"
    assert dynamic.formatted("%s and %s", ["b"], {"b": "known"}) == "known and ?"
    assert dynamic.arguments('a, f(b, c), "x, \\"y", \',\'') == ["a", "f(b, c)", '"x, \\"y"', "','"]


def test_shared_scans_run_once(spark, sf_dir):
    """Elements that a query reads several times are scanned once and stored."""
    from sourceloom.plans import inventory

    plan = inventory.c9(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
