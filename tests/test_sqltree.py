"""Rewrites of nested SQL and SQL with literals, by hand and over generated expressions."""

import random

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import rewrite as rw
from sourceloom.functions import sqltree
from sourceloom.operators import relations
from sourceloom.operators.scanner import constant, declare_sections, directives, normalized_tokens

TO_MYSQL = {
    "SELECT p || q, r FROM t": "SELECT CONCAT(p, q), r FROM t",
    "SELECT 'x y' || b": "SELECT CONCAT('x y', b)",
    "NVL(a, b) || c": "CONCAT(IFNULL(a, b), c)",
    "SELECT '||' FROM t": "SELECT '||' FROM t",
    "ADD_MONTHS(NVL(d, e), 3)": "DATE_ADD(IFNULL(d, e), INTERVAL 3 MONTH)",
    "DECODE(a, DECODE(b, 1, 2, 3), NVL(c, 'DECODE(x,1,2)'), d || e)": "CASE a WHEN CASE b WHEN 1 THEN 2 ELSE 3 END THEN IFNULL(c, 'DECODE(x,1,2)') ELSE CONCAT(d, e) END",
    "||".join("abcdefghijklmn"): "CONCAT(a, b, c, d, e, f, g, h, i, j, k, l, m, n)",
    "x + a || b * 2 || c - 1 AS z": "CONCAT(x + a, b * 2, c) - 1 AS z",
    "CASE WHEN a || b = 'c' THEN d ELSE e || f END || g": "CONCAT(CASE WHEN CONCAT(a, b) = 'c' THEN d ELSE CONCAT(e, f) END, g)",
    "MONTHS_BETWEEN(MONTHS_BETWEEN(a, b), c || d)": "TIMESTAMPDIFF(MONTH, CONCAT(c, d), TIMESTAMPDIFF(MONTH, b, a))",
    "SELECT 'NVL(a)', \"SYSDATE\", t.sysdate, SYSDATE /* NVL(b) */ FROM t": "SELECT 'NVL(a)', \"SYSDATE\", t.sysdate, NOW() /* NVL(b) */ FROM t",
    "DECODE(a, b) || pkg.NVL(x)": "CONCAT(DECODE(a, b), pkg.NVL(x))",
    "(a || b": "(CONCAT(a, b)",
    "a || ": "a || ",
    "": "",
}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_oracle_to_mysql(spark):
    rows = spark.createDataFrame([(t,) for t in [*TO_MYSQL, None]], "t string").select("t", rw.oracle_to_mysql(F.col("t")).alias("new")).collect()
    assert {r.t: r.new for r in rows} == TO_MYSQL | {None: None}


def made(rng, depth):
    """A nested expression in both dialects."""
    kind = rng.choice(["name", "literal", "number"] if not depth else ["nvl", "decode", "concat", "months", "between", "group", "case", "name", "literal"])
    sub = lambda n: list(zip(*(made(rng, depth - 1) for _ in range(n))))
    if kind == "name":
        x = rng.choice(["a", "t.b", "c_1", '"q, ("'])
        return x, x
    if kind == "literal":
        x = "'" + rng.choice(["x", "it''s", "a, b", ")", "(", "||", "NVL(a, b)", "DECODE(1,2,3)", "--", "/*", ""]) + "'"
        return x, x
    if kind == "number":
        return "12.5", "12.5"
    if kind == "nvl":
        a, b = sub(2)
        return f"NVL({', '.join(a)})", f"IFNULL({', '.join(b)})"
    if kind == "decode":
        a, b = sub(rng.choice([3, 4, 5, 6]))
        pairs = "".join(f" WHEN {b[k]} THEN {b[k + 1]}" for k in range(1, len(b) - 1, 2))
        return f"DECODE({', '.join(a)})", f"CASE {b[0]}{pairs}" + (f" ELSE {b[-1]}" if len(b) % 2 == 0 else "") + " END"
    if kind == "months":
        a, b = sub(2)
        return f"ADD_MONTHS({a[0]}, {a[1]})", f"DATE_ADD({b[0]}, INTERVAL {b[1]} MONTH)"
    if kind == "between":
        a, b = sub(2)
        return f"MONTHS_BETWEEN({a[0]}, {a[1]})", f"TIMESTAMPDIFF(MONTH, {b[1]}, {b[0]})"
    if kind == "group":
        ((a,), (b,)) = sub(1)
        return f"({a})", f"({b})"
    if kind == "case":
        a, b = sub(3)
        return f"CASE WHEN {a[0]} = 1 THEN {a[1]} ELSE {a[2]} END", f"CASE WHEN {b[0]} = 1 THEN {b[1]} ELSE {b[2]} END"
    a, b = sub(rng.choice([2, 3, 12]))
    return "(" + rng.choice([" || ", "||", " ||\n "]).join(a) + ")", f"(CONCAT({', '.join(b)}))"


@pytest.mark.parametrize("seed", range(4))
def test_generated_expressions(seed):
    rng = random.Random(seed)
    for _ in range(300):
        a, b = made(rng, 4)
        assert rw.ORACLE_TO_MYSQL.rewritten(f"SELECT {a} AS n FROM t") == f"SELECT {b} AS n FROM t"


def test_tokens_are_the_text():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["'", '"', "--", "/*", "*/", ":", "a", "(", ")", " ", "\n", "1", ";", "é", ":b.c", "||"]) for _ in range(rng.randrange(40)))
        assert "".join(t.text for t in sqltree.tokens(text)) == text
        assert rw.CONCATENATION.rewritten(text) is not None


def test_aliases_columns_and_into(spark):
    t = F.col("t")
    alias = rw.with_aliases(t, F.array(F.lit(":x_1"), F.lit(":y")))
    assert one(spark, alias, t="SELECT a, (SELECT max(b) FROM u) INTO :x_1, :y FROM t") == "SELECT a AS x1, (SELECT max(b) FROM u) AS y INTO :x_1, :y FROM t"
    assert one(spark, alias, t="SELECT EXTRACT(YEAR FROM d), b INTO :x_1, :y FROM t") == "SELECT EXTRACT(YEAR FROM d) AS x1, b AS y INTO :x_1, :y FROM t"
    assert one(spark, alias, t="SELECT 'a,b', c FROM t") == "SELECT 'a,b' AS x1, c AS y FROM t"
    assert one(spark, alias, t="SELECT a n, CASE k WHEN 1 THEN 2 END FROM t") == "SELECT a n, CASE k WHEN 1 THEN 2 END AS y FROM t"
    assert one(spark, rw.split_columns(t), t="')', c, f(',', d)") == ["')'", "c", "f(',', d)"]
    assert one(spark, rw.select_columns(t), t="INSERT INTO u SELECT a, f(b, ',') FROM t") == ["a", "f(b, ',')"]
    assert one(spark, rw.without_comments(t), t="SELECT '--x  y' FROM t -- c\n /*+ h */ /* it's */ x") == "SELECT '--x  y' FROM t /*+ h */ x"
    assert one(spark, rw.without_comments(t, hints=False), t="SELECT /*+ h */ x") == "SELECT x"
    assert one(spark, rw.parameters(t, F.array()), t="x = ':notvar' AND y = :a.b:i AND z = :c[i-1] AND u = 12:30") == "x = ':notvar' AND y = #{a_b} AND z = #{c} AND u = 12:30"
    assert one(spark, rw.without_into(t), t="SELECT 'INTO :b FROM', EXTRACT(YEAR FROM d) INTO :a, :b FROM t") == "SELECT 'INTO :b FROM', EXTRACT(YEAR FROM d) FROM t"
    assert one(spark, rw.normalized(t), t="EXEC SQL SELECT a,  'x  y' INTO :a FROM t;") == "SELECT a, 'x  y' FROM t"
    assert one(spark, rw.paged(t, "mysql"), t="SELECT ' LIMIT 3' FROM t -- LIMIT") .endswith("LIMIT #{limit} OFFSET #{offset}")


def test_merged_cursor(spark):
    merged = relations.merged_cursor_sql(F.col("d"), F.col("i"))
    text = "EXEC SQL DECLARE c CURSOR FOR SELECT EXTRACT(YEAR FROM d), (SELECT 1 FROM u) FROM t WHERE 'FROM' = x;"
    assert one(spark, merged, d=text, i="INTO :a, :b") == "SELECT EXTRACT(YEAR FROM d), (SELECT 1 FROM u) INTO :a, :b FROM t WHERE 'FROM' = x"


def test_other_dialects(spark):
    t = F.col("t")
    assert one(spark, rw.DIALECTS["db2", "mysql"](t), t="SELECT VALUE(a, 'VALUE(') , CURRENT  DATE FROM t WHERE x = 'CURRENT DATE' FETCH FIRST 5 ROWS ONLY") == "SELECT IFNULL(a, 'VALUE(') , CURDATE() FROM t WHERE x = 'CURRENT DATE'"
    assert one(spark, rw.DIALECTS["mysql", "oracle"](t), t="SELECT IFNULL(a, NOW()), CURDATE(), 'LIMIT 3' FROM t LIMIT 3 OFFSET 4") == "SELECT NVL(a, SYSDATE), TRUNC(SYSDATE), 'LIMIT 3' FROM t"


def test_scanner():
    got = next(normalized_tokens("EXEC SQL SELECT (SELECT max(x) FROM u), 'INTO :z' INTO :a FROM t WHERE b = :c"))
    assert got == {"sql": "SELECT (SELECT max(x) FROM u), 'INTO :z' FROM t WHERE b = ?", "inputs": [":c"], "outputs": [":a"]}
    text = 'EXEC SQL BEGIN DECLARE SECTION; int a; EXEC SQL END DECLARE SECTION;'
    assert [d["raw"].strip() for d in declare_sections(f"/* {text} */ char *s = \"{text}\";\n{text}")] == ["int a;"]
    found = list(directives('/* #include "no.h" */\n#include <a.h>\n/*\n#define NO 1\n*/\n  # define YES 2 /* two */\n#define F(x) x\nEXEC SQL INCLUDE b;\n#define S "/* kept */"\n'))
    assert [(d["kind"], d["name"], d["value"]) for d in found] == [("include", "a.h", "system"), ("macro", "YES", "2"), ("include", "b", "sql"), ("macro", "S", '"/* kept */"')]
    chain = {f"M{k}": f"M{k + 1} + 1" for k in range(3000)} | {"M3000": "0x10"}
    assert constant("2 * (M0)", chain) == 2 * (3000 + 16)
    assert constant("A", {"A": "B", "B": "A + 1"}) is None and constant("A + 1", {"A": ""}) is None and constant("1 +") is None
