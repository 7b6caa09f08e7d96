"""A corpus of embedded-SQL statements derived from ``orders``, alike in Spark SQL and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: statement(file_id, function, line_start, sql_text); ``{s}`` is the string type
STATEMENTS = """
SELECT o_custkey AS file_id, concat('fn_', CAST(o_orderkey % 5 AS {s})) AS function, o_orderkey AS line_start,
  CASE o_orderkey % 16
    WHEN 0 THEN concat('EXEC SQL SELECT o_totalprice, o_clerk_name INTO :h_price, :h_clerk FROM orders WHERE o_orderkey = :h_key_', CAST(o_orderkey AS {s}), ';')
    WHEN 1 THEN 'EXEC SQL INSERT INTO audit_log VALUES (:h_id, :rec.name:ind);'
    WHEN 2 THEN 'EXEC SQL UPDATE orders SET o_orderstatus = :st[0] WHERE o_custkey = :h_cust;'
    WHEN 3 THEN concat('EXEC SQL DECLARE c', CAST(o_custkey AS {s}), '_ CURSOR FOR SELECT a_id, b_name FROM t WHERE b = :h_b;')
    WHEN 4 THEN concat('EXEC SQL OPEN c', CAST(o_custkey AS {s}), '_;')
    WHEN 5 THEN concat('EXEC SQL FETCH c', CAST(o_custkey AS {s}), '_ INTO :h_a, :h_b:ind;')
    WHEN 6 THEN 'EXEC SQL COMMIT WORK;'
    WHEN 7 THEN 'EXEC SQL ROLLBACK;'
    WHEN 8 THEN concat('EXEC SQL CLOSE c', CAST(o_custkey AS {s}), '_;')
    WHEN 9 THEN concat('EXEC SQL PREPARE s', CAST(o_custkey AS {s}), '_ FROM :stmt_buf;')
    WHEN 10 THEN concat('EXEC SQL EXECUTE s', CAST(o_custkey AS {s}), '_ USING :h_arg;')
    WHEN 11 THEN 'EXEC SQL FOR :batch_size INSERT INTO emp_t (id, name) VALUES (:ids[i], :names[i]);'
    WHEN 12 THEN 'EXEC SQL DELETE FROM tmp_t WHERE d < NVL(:cut_date, SYSDATE) AND SUBSTR(nm, 1, 2) = DECODE(k, 1, :x1, :x2);'
    WHEN 13 THEN 'EXEC SQL SELECT cust_id, user_name FROM cust_t WHERE first_nm || last_nm = :full_nm FETCH FIRST 10 ROWS ONLY WITH UR;'
    WHEN 14 THEN 'EXEC SQL INCLUDE SQLCA;'
    ELSE 'EXEC SQL WHENEVER SQLERROR GOTO err_exit;' END AS sql_text
FROM {orders}"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATEMENTS.replace("{s}", "STRING"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def check_statements() -> str:
    """The corpus as a named query ``st`` for the checking engine."""
    return "WITH st AS (" + STATEMENTS.replace("{s}", "VARCHAR").replace("{orders}", "orders") + ")"


#: files(file_id, content): a source file for each customer, moved down by some lines and stretched by others
FILES = """
SELECT c_custkey AS file_id, concat(repeat(chr(10), CAST(c_custkey % 5 AS INT)), 'int g_count;', chr(10), 'EXEC SQL BEGIN DECLARE SECTION;', chr(10), 'char h_name[20];', chr(10),
  'int h_', CAST(c_custkey AS {s}), ';', chr(10), 'EXEC SQL END DECLARE SECTION;', chr(10), 'static int s_total;', chr(10), 'void fn_', CAST(c_custkey AS {s}), '(void) ', chr(123), chr(10), '  int loc;', chr(10), '  static int hits;', chr(10),
  repeat(chr(10), CAST(c_custkey % 3 AS INT)), '  EXEC SQL SELECT a FROM t WHERE x = :h_name;', chr(10), chr(125), chr(10)) AS content
FROM {customer}"""
#: headers(file_id, content): a header for each supplier, which includes another and one of the system's
HEADERS = """
SELECT concat('h', CAST(s_suppkey AS {s}), '.h') AS file_id, concat('#include "h', CAST(CAST(floor(s_suppkey / 3) AS INT) AS {s}), '.h"', chr(10), '#include <stdio.h>', chr(10),
  '#define LIMIT_', CAST(s_suppkey AS {s}), ' (s_total + ', CAST(s_nationkey AS {s}), ')', chr(10)) AS content
FROM {supplier}"""


def derived(spark: SparkSession, sf_dir: str, text: str, table: str) -> DataFrame:
    return spark.sql(text.replace("{s}", "STRING"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def check_derived(name: str, text: str, table: str) -> str:
    """The same for the checking engine, as a named query."""
    return f"WITH {name} AS (" + text.replace("{s}", "VARCHAR").replace("{" + table + "}", table) + ")"
