"""Edit scripts against a plain dynamic program, ranges, unified form, and the table function."""

import difflib
import random
import re

from pyspark.sql import functions as F

from sourceloom.functions.corpus import statements
from sourceloom.functions import hostvars as hv
from sourceloom.functions import rewrite as rw
from sourceloom.operators import diffs


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_scripts_are_shortest_and_lead_from_one_to_the_other():
    rng = random.Random(1)
    for _ in range(1500):
        n, m, letters = rng.randrange(14), rng.randrange(14), rng.choice(["ab", "abcd", "abcdefgh"])
        a, b = [rng.choice(letters) for _ in range(n)], [rng.choice(letters + "z") for _ in range(m)]
        ops, same = diffs.edits(a, b)
        assert same == longest(a, b)
        made, at = [], 0
        for op, i0, i1, j0, j1 in ops:
            assert (op == "insert") == (i0 == i1) and (op == "delete") == (j0 == j1)
            made += a[at:i0] + b[j0:j1]
            at = i1
        assert made + a[at:] == b


def test_long_texts_stay_linear_in_memory():
    a = [str(k) for k in range(20_000)]
    b = a[:5000] + ["x"] * 3 + a[5003:15_000] + a[15_100:]
    assert diffs.edits(a, b) == ([("replace", 5000, 5003, 5000, 5003), ("delete", 15_000, 15_100, 15_000, 15_000)], 20_000 - 103)


def test_unified_form_is_the_usual_one():
    rng = random.Random(2)
    for _ in range(200):
        a = [f"line {rng.randrange(1000)}" for _ in range(rng.randrange(30))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randrange(len(b) + 1), f"new {rng.random()}")
        want = "\n".join(x for x in difflib.unified_diff(a, b, lineterm="", n=3))
        got = diffs.unified("\n".join(a), "\n".join(b))
        if len(set(a)) == len(a):
            assert got == re.sub(r"^--- \n\+\+\+ \n", "", want)


def test_all_statement_pairs(spark, sf_dir):
    text = F.col("sql_text")
    pairs = statements(spark, sf_dir).select("line_start", text.alias("sql"), rw.parameters(rw.normalized(text), hv.variables(text)).alias("parsed_sql"))
    ranges = diffs.diff_ranges(pairs).groupBy("line_start").agg(F.collect_list(F.struct("op", "a_start", "a_end", "b_start", "b_end")).alias("ops"))
    rows = diffs.diff_summary(pairs).join(ranges, "line_start", "left").collect()
    assert len(rows) > 1000
    words = lambda t: re.findall(r"\w+|[^\w\s]", t)
    for r in rows:
        a, b = words(r.sql), words(r.parsed_sql)
        assert r.similarity == round(2 * longest(a, b) / max(1, len(a) + len(b)), 6)
        assert len(r.ops or []) == r.replaced + r.deleted + r.inserted
        made, at = "", 0
        for o in sorted(r.ops or [], key=lambda o: (o.a_start, o.b_start)):
            made += r.sql[at : o.a_start] + r.parsed_sql[o.b_start : o.b_end]
            at = o.a_end
        assert words(made + r.sql[at:]) == b


def test_table_function_nulls_and_case(spark):
    diffs.register(spark)
    spark.createDataFrame([(1, "SELECT id FROM users", "SELECT id, name FROM users"), (2, None, "x"), (3, "A b", "a B"), (4, None, None)], "k long, sql string, parsed_sql string").createOrReplaceTempView("diff_pairs")
    rows = spark.sql("SELECT k, d.* FROM diff_pairs, LATERAL diff_ranges(sql, parsed_sql) AS d ORDER BY k, a_start").collect()
    assert [tuple(r) for r in rows] == [(1, "insert", 9, 9, 9, 15), (2, "insert", 0, 0, 0, 1), (3, "replace", 0, 3, 0, 3)]
    assert diffs.diff_ranges(spark.table("diff_pairs"), ignore_case=True).where("k = 3").count() == 0
    assert {r.k: r.similarity for r in diffs.diff_summary(spark.table("diff_pairs")).collect()} == {1: 0.8, 2: 0.0, 3: 0.0, 4: 1.0}
    assert spark.sql("SELECT 1").select(diffs.unified_diff(F.lit("a\nb"), F.lit("a\nc")).alias("d")).first().d == "@@ -1,2 +1,2 @@\n a\n-b\n+c"
