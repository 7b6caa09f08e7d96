"""Registered queries of nested SQL: texts with literals, calls and sub-selects made from ``orders``, and what they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hostvars as hv
from ..functions import rewrite as rw
from ..operators import diffs, relations
from ..storage import spread
from .queries import query, read


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """(k, t): a text for each order."""
    return spread(read(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("k"), F.expr(text).alias("t"))


@query(
    "h4_nested",
    """SELECT o_orderkey AS k, concat('SELECT CONCAT(IFNULL(a, ''', o_orderpriority, ', ||''), b', o_orderkey % 7, ', (CONCAT(c, ', o_orderkey, ')), CASE s WHEN ', o_orderkey % 3, ' THEN CONCAT(x, y) ELSE IFNULL(z, ', o_orderkey % 5, ') END', repeat(', e', CAST(o_orderkey % 20 AS INT)),
 ') AS t FROM u WHERE CONCAT(p, q * 2) = ''', o_orderstatus, '||''') AS sql FROM orders""",
)
def h4(spark, sf_dir):
    text = "concat('SELECT NVL(a, \\'', o_orderpriority, ', ||\\') || b', o_orderkey % 7, '||(c || ', o_orderkey, ') || DECODE(s, ', o_orderkey % 3, ', x||y, NVL(z, ', o_orderkey % 5, '))', repeat(' || e', cast(o_orderkey % 20 as int)), ' AS t FROM u WHERE p || q * 2 = \\'', o_orderstatus, '||\\'')"
    return made(spark, sf_dir, text).select("k", rw.oracle_to_mysql(F.col("t")).alias("sql"))


@query(
    "h3_nested",
    """SELECT o_orderkey AS k, concat(repeat('CASE a WHEN 1 THEN ', CAST(o_orderkey % 6 + 1 AS INT)), 'DATE_ADD(IFNULL(d, ''', o_orderpriority, '(''), INTERVAL ', o_orderkey % 12, ' MONTH)', repeat(' ELSE TIMESTAMPDIFF(MONTH, v, IF(u, w, ''DECODE(x,1,2)'')) END', CAST(o_orderkey % 6 + 1 AS INT))) AS sql FROM orders""",
)
def h3(spark, sf_dir):
    text = "concat(repeat('DECODE(a, 1, ', cast(o_orderkey % 6 + 1 as int)), 'ADD_MONTHS(NVL(d, \\'', o_orderpriority, '(\\'), ', o_orderkey % 12, ')', repeat(', MONTHS_BETWEEN(NVL2(u, w, \\'DECODE(x,1,2)\\'), v))', cast(o_orderkey % 6 + 1 as int)))"
    return made(spark, sf_dir, text).select("k", rw.oracle_to_mysql(F.col("t")).alias("sql"))


_COLUMNS = """'EXTRACT(YEAR FROM d', o_orderkey % 5, '){x}, (SELECT max(b), 1 FROM u WHERE v = ''', o_orderpriority, ', FROM''){y}, ''p, (q''{z}, f(', o_orderkey, ', g(1, 2)) n'"""


@query("n8_nested", "SELECT o_orderkey AS k, concat('SELECT ', " + _COLUMNS.replace("{x}", " AS hYear").replace("{y}", " AS hB").replace("{z}", " AS hC") + ", ' INTO :h_year, :h_b, :h_c, :h_', o_orderkey % 3, ' FROM t WHERE x = '':h_y''') AS sql FROM orders")
def n8(spark, sf_dir):
    text = "concat('SELECT ', " + _COLUMNS.replace("{x}", "").replace("{y}", "").replace("{z}", "").replace("''", "\\'") + ", ' INTO :h_year, :h_b, :h_c, :h_', o_orderkey % 3, ' FROM t WHERE x = \\':h_y\\'')"
    aliases = F.array(*(F.lit(f":{v}") for v in ("h_year", "h_b", "h_c", "h_0")))
    return made(spark, sf_dir, text).select("k", rw.with_aliases(F.col("t"), aliases).alias("sql"))


@query(
    "n11_nested",
    """SELECT o_orderkey AS k, CAST(unnest([1, 2, 3, 4]) AS BIGINT) AS pos, unnest(['EXTRACT(YEAR FROM d' || o_orderkey % 5 || ')', '(SELECT max(b), 1 FROM u WHERE v = ''' || o_orderpriority || ', FROM'')', '''p, (q''', 'f(' || o_orderkey || ', g(1, 2)) n']) AS col FROM orders""",
)
def n11(spark, sf_dir):
    text = "concat('SELECT ', " + _COLUMNS.replace("{x}", "").replace("{y}", "").replace("{z}", "").replace("''", "\\'") + ", ' FROM t')"
    return made(spark, sf_dir, text).select("k", F.posexplode(rw.select_columns(F.col("t"))).alias("p", "col")).select("k", (F.col("p") + 1).cast("long").alias("pos"), "col")


@query("n13_literals", """SELECT o_orderkey AS k, concat('SELECT ''--', o_orderpriority, '  /* kept */'', a /*+ INDEX(t ', o_orderkey, ') */ , b FROM t WHERE c = ''it''''s -- ', o_orderkey % 9, '''') AS sql FROM orders""")
def n13(spark, sf_dir):
    text = "concat('SELECT \\'--', o_orderpriority, '  /* kept */\\', a /*+ INDEX(t ', o_orderkey, ') */ -- it\\'s gone\n, b /* \\'', o_orderkey % 4, ' */ FROM t WHERE c = \\'it\\'\\'s -- ', o_orderkey % 9, '\\'')"
    return made(spark, sf_dir, text).select("k", rw.without_comments(F.col("t")).alias("sql"))


@query("n5_literals", """SELECT o_orderkey AS k, concat('UPDATE t SET a = #{h_', o_orderkey % 8, '}, b = '':no', o_orderkey, ''', c = #{r_m}, d = ''12:30'' WHERE e = #{v} AND f > 10:20') AS sql FROM orders""")
def n5(spark, sf_dir):
    text = "concat('UPDATE t SET a = :h_', o_orderkey % 8, ':ind, b = \\':no', o_orderkey, '\\', c = :r.m, d = \\'12:30\\' WHERE e = :v[i-', o_orderkey % 3, '] AND f > 10:20')"
    return made(spark, sf_dir, text).select("k", rw.parameters(F.col("t"), hv.variables(F.col("t"))).alias("sql"))


@query("n3_nested", """SELECT o_orderkey AS k, concat('SELECT (SELECT max(x) FROM u WHERE y = #{h_in}) AS hA, '' INTO :no FROM ', o_orderstatus, ''' AS hB FROM t WHERE k = #{h_', o_orderkey % 6, '}') AS sql FROM orders""")
def n3(spark, sf_dir):
    text = "concat('EXEC SQL SELECT (SELECT max(x) FROM u WHERE y = :h_in), \\' INTO :no FROM ', o_orderstatus, '\\'\n INTO :h_a, :h_b FROM t WHERE k = :h_', o_orderkey % 6, ';')"
    t = F.col("t")
    into = F.array(F.lit(":h_a"), F.lit(":h_b"))
    return made(spark, sf_dir, text).select("k", rw.mapper_sql(t, F.lit("select"), into, hv.variables(t)).alias("sql"))


@query("a3_nested", """SELECT o_orderkey AS k, concat('SELECT EXTRACT(MONTH FROM d), (SELECT ''', o_orderpriority, ' FROM'' FROM u) INTO :h_', o_orderkey % 4, ', :h_z FROM t WHERE a = ''FROM', o_orderkey, '''') AS sql FROM orders""")
def a3(spark, sf_dir):
    text = "concat('EXEC SQL DECLARE c', o_orderkey, ' CURSOR FOR SELECT EXTRACT(MONTH FROM d), (SELECT \\'', o_orderpriority, ' FROM\\' FROM u) FROM t WHERE a = \\'FROM', o_orderkey, '\\';')"
    return made(spark, sf_dir, text).select("k", relations.merged_cursor_sql(F.col("t"), F.expr("concat('INTO :h_', k % 4, ', :h_z')")).alias("sql"))


@query("h8_literals", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN concat('SELECT a FROM t LIMIT ', o_orderkey) ELSE concat('SELECT '' LIMIT ', o_orderkey, ''' FROM t LIMIT #{limit} OFFSET #{offset}') END AS sql FROM orders""")
def h8(spark, sf_dir):
    text = "if(o_orderkey % 3 = 0, concat('SELECT a FROM t LIMIT ', o_orderkey), concat('SELECT \\' LIMIT ', o_orderkey, '\\' FROM t'))"
    return made(spark, sf_dir, text).select("k", rw.paged(F.col("t"), "mysql").alias("sql"))


#: a statement and its conversion: the status changes, ', name' is put in, ' AND a = ...' goes, some words repeat
_BEFORE = "concat('SELECT id FROM t_', o_orderkey, repeat(' x ,', cast(o_orderkey % 4 as int)), ' WHERE s = ', o_orderstatus, ' AND a > ', o_orderkey % 9) AS sql"
_AFTER = "concat('SELECT id, name  FROM t_', o_orderkey, repeat(' x ,', cast(o_orderkey % 4 as int)), ' WHERE s = #{st}') AS parsed_sql"


@query(
    "k3_diff_ranges",
    """WITH p AS (SELECT o_orderkey AS k, CAST(9 + length(concat(' FROM t_', o_orderkey, repeat(' x ,', CAST(o_orderkey % 4 AS INT)), ' WHERE s =')) AS INTEGER) AS a, length(concat(o_orderstatus, ' AND a > ', o_orderkey % 9)) AS n FROM orders)
 SELECT k, 'insert' AS op, 9 AS a_start, 9 AS a_end, 9 AS b_start, 15 AS b_end FROM p UNION ALL SELECT k, 'replace', a + 1, CAST(a + 1 + n AS INTEGER), a + 8, a + 13 FROM p""",
)
def k3(spark, sf_dir):
    pairs = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", _BEFORE, _AFTER)
    return diffs.diff_ranges(pairs).drop("sql", "parsed_sql")


@query("k3_diff_summary", """SELECT o_orderkey AS k, round(2 * (7 + 2 * (o_orderkey % 4)) / (25 + 4 * (o_orderkey % 4))::DOUBLE, 6) AS similarity, CAST(1 AS BIGINT) AS replaced, CAST(0 AS BIGINT) AS deleted, CAST(1 AS BIGINT) AS inserted FROM orders""")
def k3_summary(spark, sf_dir):
    pairs = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", _BEFORE, _AFTER)
    return diffs.diff_summary(pairs).drop("sql", "parsed_sql")


@query("n23_line_diffs", """SELECT o_orderkey AS k, '@@ -1,5 +1,5 @@' || chr(10) || ' open c' || chr(10) || '-' || o_orderstatus || chr(10) || '+status' || chr(10) || ' key ' || o_orderkey || chr(10) || ' end' || chr(10) || ' close c' AS diff FROM orders""")
def n23(spark, sf_dir):
    lines = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "concat_ws('\n', 'open c', o_orderstatus, concat('key ', o_orderkey), 'end', 'close c') AS a", "concat_ws('\n', 'open c', 'status', concat('key ', o_orderkey), 'end', 'close c') AS b")
    return lines.select("k", diffs.unified_diff(F.col("a"), F.col("b")).alias("diff"))
