"""Rules, variables and rewrites on single texts."""

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import hostvars as hv
from sourceloom.functions import rewrite as rw
from sourceloom.functions import rules
from sourceloom.operators import scanner


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "text, kind",
    [
        ("EXEC SQL INCLUDE SQLCA;", "include"),
        ("EXEC SQL BEGIN DECLARE SECTION;", "declare_section_begin"),
        ("exec sql declare c1 cursor for select a from t;", "declare_cursor"),
        ("EXEC SQL FETCH c1\n INTO :a;", "fetch_into"),
        ("EXEC SQL OPEN c1;", "open_cursor"),
        ("EXEC SQL WHENEVER SQLERROR STOP;", "whenever"),
        ("EXEC SQL /* h */ SELECT 1 INTO :a FROM t;", "select"),
        ("EXEC SQL ROLLBACK;", "rollback"),
        ("EXEC SQL SAVEPOINT s;", "unknown"),
    ],
)
def test_sql_types(spark, text, kind):
    assert one(spark, rules.sql_type(F.col("t")), t=text) == kind


def test_own_rule_goes_before_lower_priorities(spark):
    own = rules.RuleSet().register(rules.Rule("hinted", 55, r"EXEC\s+SQL\s+SELECT\s+/\*\+"))
    assert one(spark, own.compile(F.col("t")), t="EXEC SQL SELECT /*+ x */ 1 FROM t;") == "hinted"
    assert own.clear().ordered() == []


def test_dialect_metadata(spark):
    got = one(spark, rules.db2_metadata(F.col("t")), t="EXEC SQL SELECT a FROM t FETCH FIRST 5 ROWS ONLY WITH UR;")
    assert got == {"isolation_level": "UR", "fetch_first": "5", "dbms": "db2"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("INTO :a, :b:ind", [":a", ":b:ind"]),
        (":arr[0] :rec.f :rec.g:i :arr[i]:n", [":arr[0]", ":rec.f", ":rec.g:i", ":arr[i]:n"]),
        ("TO_CHAR(d, 'HH24:MI:SS') = :x", [":x"]),
        ("WHERE a = ':no' AND b = :yes", [":yes"]),
        ("", []),
    ],
)
def test_variables(spark, text, want):
    assert one(spark, hv.variables(F.col("t")), t=text) == want


def test_direction(spark):
    text = "EXEC SQL SELECT a INTO :x FROM t WHERE b = :x AND c = :y;"
    kind = F.lit("select")
    assert one(spark, hv.outputs(F.col("t"), kind), t=text) == [":x"]
    assert one(spark, hv.inputs(F.col("t"), kind), t=text) == [":x", ":y"]
    assert one(spark, hv.inputs_by_value(F.col("t"), kind), t=text) == [":y"]


@pytest.mark.parametrize("name, want", [("user_name", "userName"), ("rfrn_strt_date", "rfrnStrtDate"), ("userName", "username"), ("spaa010p_inrec1", "spaa010pInrec1"), ("a_b2c", "aB2C")])
def test_camel(spark, name, want):
    assert one(spark, rw.camel(F.col("t")), t=name) == want


def test_class_name_capitalises_after_digits(spark):
    assert one(spark, rw.class_name(F.col("t")), t="x_spaa010p_inrec1_t") == "XSpaa010PInrec1"


def test_rewrites(spark):
    c = F.col("t")
    assert one(spark, rw.normalized(c), t="EXEC SQL SELECT a\n INTO :f1, :b FROM t ;") == "SELECT a FROM t"
    assert one(spark, rw.split_columns(c), t="a, f(b, c), d") == ["a", "f(b, c)", "d"]
    assert one(spark, rw.with_aliases(c, F.array(F.lit(":user_id"), F.lit(":nm"))), t="SELECT id, name AS n FROM t") == "SELECT id AS userId, name AS n FROM t"
    assert one(spark, rw.decode_to_case(c), t="SELECT DECODE(a, 1, 'x', 'y') FROM t") == "SELECT CASE a WHEN 1 THEN 'x' ELSE 'y' END FROM t"
    assert one(spark, rw.without_comments(c), t="SELECT /*+ keep */ a /* drop */ FROM t") == "SELECT /*+ keep */ a FROM t"
    assert one(spark, rw.json_block(c), t='say\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, rw.paged(c, "mysql"), t="SELECT 1 LIMIT 3") == "SELECT 1 LIMIT 3"
    assert one(spark, rw.rendered(c, F.create_map(F.lit("k"), F.lit("v"))), t="${k}-${x}") == "v-${x}"
    assert one(spark, rw.parameters(c, hv.variables(c)), t=":a[1]:i + :r.f") == "#{a} + #{r_f}"


@pytest.mark.parametrize("text, want", [("8 + 1", 9), ("(2+3)*4 % 7", 6), ("7/2", 3), ("0x10", 16), ("N - 1", 11), ("f(2)", None), ("", None), ("__import__('os')", None)])
def test_constants(text, want):
    assert scanner.constant(text, {"N": "(M * 2)", "M": "6"}) == want


SOURCE = """#include <stdio.h>
#include "a.h"
#define MAX_N 10 /* ten */
#define F(x) x
/* EXEC SQL SELECT hidden; */
static int total;
EXEC SQL INCLUDE SQLCA;
int main(void) {
  char buf[MAX_N];
  char *s = "EXEC SQL no;";
  EXEC SQL SELECT 'a;b' INTO :x FROM t;
  go(buf, f(1)); // EXEC SQL no;
}
"""


def test_scanners():
    assert [b["raw"] for b in scanner.sql_blocks(SOURCE)] == ["EXEC SQL INCLUDE SQLCA;", "EXEC SQL SELECT 'a;b' INTO :x FROM t;"]
    assert [(d["kind"], d["name"], d["value"]) for d in scanner.directives(SOURCE)] == [("include", "stdio.h", "system"), ("include", "a.h", "local"), ("macro", "MAX_N", "10"), ("include", "SQLCA", "sql")]
    found = [(e["kind"], e["name"], e["parent"]) for e in scanner.c_elements(SOURCE)]
    assert ("function", "main", None) in found and ("function_call", "go", "main") in found and ("variable", "buf", None) in found and ("variable", "total", None) in found
    assert [c["is_multiline"] for c in scanner.comments(SOURCE)] == [True, False]
    assert list(scanner.sql_blocks("EXEC SQL SELECT 1")) == []


def test_header_fields():
    text = "#define L 4\ntypedef struct {\n  char nm[L + 1]; // name\n  long amt; /* money */\n  int k;\n} rec_t;\nstruct_stp x;\nst rec_stp[] = { {'c', 4, 0, 1}, {'d', 13, 2, 1}, {'\\0', 0, 0, 0} };"
    got = [(f["name"], f["size"], f["decimal"], f["description"]) for f in scanner.header_fields(text)]
    assert got == [("nm", 5, 0, "name"), ("amt", 13, 2, "money"), ("k", 9, 0, None)]


def test_chunks_cover_and_move_on():
    text = "select 1;\n" * 900
    parts = list(scanner.chunks(text, 1000, 200))
    assert parts[0]["start"] == 0 and parts[-1]["end"] == len(text)
    assert all(a["start"] < b["start"] <= a["end"] for a, b in zip(parts, parts[1:]))
    assert len(list(scanner.chunks("x" * 50, 10, 20))) < 60
