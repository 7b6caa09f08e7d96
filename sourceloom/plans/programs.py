"""Registered queries over programs made from the tables: scopes, built SQL, graphs over headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import automaton
from ..functions.corpus import statements
from ..operators import chunked, dynamic, extensions, program_graph, relations, search
from ..operators.scanner import scan_files
from .queries import ST, query, read, source_texts

_SPANS = "sp AS (SELECT file_id, line_start AS s, line_start + 10 + line_start % 97 AS e, 'f' || line_start AS name FROM st WHERE line_start % 3 = 0)"


def _spans(st: DataFrame) -> DataFrame:
    """Spans that overlap in any way."""
    return st.where("line_start % 3 = 0").selectExpr("file_id", "line_start", "line_start + 10 + line_start % 97 AS line_end", "concat('f', line_start) AS name")


@query("j1_first_of_overlapping", ST + ", " + _SPANS + " SELECT st.line_start, arg_min(sp.name, sp.s) AS function FROM st LEFT JOIN sp ON sp.file_id = st.file_id AND sp.s <= st.line_start AND sp.e >= st.line_start + st.line_start % 5 GROUP BY st.line_start")
def j1(spark, sf_dir):
    st = statements(spark, sf_dir)
    return relations.scoped(st.withColumn("line_end", F.expr("line_start + line_start % 5")), _spans(st)).select("line_start", "function")


@query("j2_innermost_by_start", ST + ", " + _SPANS + " SELECT st.line_start, arg_max(sp.name, sp.s) AS function FROM st LEFT JOIN sp ON sp.file_id = st.file_id AND sp.s <= st.line_start AND sp.e >= st.line_start GROUP BY st.line_start")
def j2(spark, sf_dir):
    st = statements(spark, sf_dir)
    return relations.scoped(st.withColumn("line_end", F.expr("line_start + 500")), _spans(st), start_only=True, innermost=True).select("line_start", "function")


@query("j3_unknown_spans", ST + ", " + _SPANS + " SELECT st.line_start, CASE WHEN st.line_start % 7 > 0 THEN arg_min(sp.name, sp.s) END AS function FROM st LEFT JOIN sp ON sp.file_id = st.file_id AND sp.s <= st.line_start AND sp.e >= st.line_start + CASE WHEN st.line_start % 2 = 0 THEN 0 ELSE 6 END GROUP BY st.line_start")
def j3(spark, sf_dir):
    st = statements(spark, sf_dir)
    unknown = st.withColumn("k", F.col("line_start")).withColumn("line_end", F.expr("if(line_start % 2 = 0, null, line_start + 6)")).withColumn("line_start", F.expr("if(line_start % 7 = 0, null, line_start)"))
    return relations.scoped(unknown, _spans(st)).select(F.col("k").alias("line_start"), "function")


#: a program for each customer: a function that writes to a buffer and prepares it, one line for each order
_LINES = """
SELECT o_custkey AS file_id, o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN concat('strcpy(buf, "SELECT ', o_orderstatus, ' ");') WHEN 1 THEN concat('strcat(buf, "FROM t', o_orderkey, ' ");')
  WHEN 2 THEN concat('strncat(buf, " WHERE x = 1 OR y", ', CAST(6 + o_orderkey % 5 AS {s}), ');') WHEN 3 THEN 'EXEC SQL PREPARE st FROM :buf;'
  WHEN 4 THEN concat('sprintf(buf, "DELETE FROM %s WHERE id = %04d AND c = %s", "u', o_orderkey, '", 7, p', o_orderkey, ');') ELSE 'strncpy(buf, "UPDATE t SET a = 1", 8);' END AS line
FROM {orders}"""


@query(
    "a6_prepared_sql",
    """WITH l AS (SELECT o_custkey AS file_id, o_orderkey AS k, o_orderkey % 6 AS kind, CASE o_orderkey % 6 WHEN 0 THEN concat('SELECT ', o_orderstatus, ' ') WHEN 1 THEN concat('FROM t', o_orderkey, ' ') WHEN 2 THEN substr(' WHERE x = 1 OR y', 1, CAST(6 + o_orderkey % 5 AS INT))
 WHEN 4 THEN concat('DELETE FROM u', o_orderkey, ' WHERE id = 0007 AND c = ?') WHEN 5 THEN 'UPDATE t' END AS v FROM orders),
 g AS (SELECT *, count(CASE WHEN kind IN (0, 4, 5) THEN 1 END) OVER (PARTITION BY file_id ORDER BY k) AS grp, row_number() OVER (PARTITION BY file_id ORDER BY k) AS line_no FROM l),
 t AS (SELECT *, string_agg(v, '') OVER (PARTITION BY file_id, grp ORDER BY k) AS text, count(v) OVER (PARTITION BY file_id ORDER BY k) AS ops, count(CASE WHEN kind = 4 THEN 1 END) OVER (PARTITION BY file_id ORDER BY k) AS odd FROM g)
 SELECT file_id, 'fn' AS function, line_no + 1 AS prepare_line, text AS sql_text, CASE WHEN text IS NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1 - 0.05 * ops::DOUBLE - 0.1 * odd::DOUBLE)), 4) END AS confidence FROM t WHERE kind = 3""",
)
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES.replace("{s}", "STRING"), orders=read(spark, sf_dir, "orders"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")
    files = lines.groupBy("file_id").agg(F.concat(F.lit("void fn(void) {\n"), body, F.lit("\n}\n")).alias("content"))
    c = scan_files(files, "c")
    blocks = relations.scoped(scan_files(files, "sql"), c.where("kind = 'function'")).withColumn("sql_text", F.col("raw"))
    calls = c.where("kind = 'function_call'").withColumn("function", F.col("parent"))
    return dynamic.prepared_sql(calls, blocks).select("file_id", "function", "prepare_line", "sql_text", "confidence")


#: two files for each part: a source with a function, and a header that includes another
_PROGRAM = """
SELECT concat('src/s', p_partkey, '.c') AS path, concat('#include "h', p_partkey, '.h"', chr(10), '#include <stdio.h>', chr(10), '/* #include "no.h" */', chr(10), 'int g_', p_partkey, ';', chr(10),
  'void f', p_partkey, '(void) ', chr(123), chr(10), '  int a;', chr(10), '  int b;', chr(10), '  rec_t rec;', chr(10), '  b = a + g_', p_partkey, ';', chr(10), '  rec.fld = b;', chr(10), '  if (rec.other == 1) f', CAST(floor(p_partkey / 2) AS INT), '(a); printf("a = b;");', chr(10), chr(125), chr(10)) AS content FROM {part}
UNION ALL
SELECT concat('inc/h', p_partkey, '.h'), concat('#include "../inc/./h', CAST(floor(p_partkey / 3) AS INT), '.h"', chr(10), '#define N ', p_partkey, chr(10)) FROM {part}"""

#: what the sources of all parts that 250 divides lead to
_REACHED = """WITH RECURSIVE f(k) AS (SELECT p_partkey FROM part WHERE p_partkey % 250 = 0 UNION SELECT CAST(floor(k / 2) AS INT) FROM f WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = CAST(floor(k / 2) AS INT))),
 h(k) AS (SELECT k FROM f UNION SELECT CAST(floor(k / 3) AS INT) FROM h WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = CAST(floor(k / 3) AS INT)))"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    files = spark.sql(_PROGRAM, part=part)
    return program_graph.program_graph(files, part.where("p_partkey % 250 = 0").select(F.expr("concat('src/s', p_partkey, '.c')").alias("path")), ["lib", "inc"])


@query(
    "g4_program_edges",
    _REACHED
    + """ SELECT 'file:src/s' || k || '.c' AS source_id, 'file:inc/h' || k || '.h' AS target_id, 'INCLUDES' AS kind FROM f UNION ALL SELECT 'file:src/s' || k || '.c', 'header:stdio.h', 'INCLUDES' FROM f
 UNION ALL SELECT 'file:inc/h' || k || '.h', CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = CAST(floor(k / 3) AS INT)) THEN 'file:inc/h' || CAST(floor(k / 3) AS INT) || '.h' ELSE 'header:../inc/./h' || CAST(floor(k / 3) AS INT) || '.h' END, 'INCLUDES' FROM h
 UNION ALL SELECT 'file:src/s' || k || '.c', 'function:src/s' || k || '.c::f' || k, 'CONTAINS' FROM f UNION ALL SELECT 'function:src/s' || k || '.c::f' || k, 'external:printf', 'CALLS' FROM f
 UNION ALL SELECT 'function:src/s' || k || '.c::f' || k, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = CAST(floor(k / 2) AS INT)) THEN 'function:src/s' || CAST(floor(k / 2) AS INT) || '.c::f' || CAST(floor(k / 2) AS INT) ELSE 'external:f' || CAST(floor(k / 2) AS INT) END, 'CALLS' FROM f
 UNION ALL SELECT 'variable:src/s' || k || '.c::' || x, 'variable:src/s' || k || '.c::b', 'DATA_FLOW' FROM (SELECT k, unnest(['a', 'g_' || k]) AS x FROM f)
 UNION ALL SELECT 'variable:src/s' || k || '.c::rec', 'member:src/s' || k || '.c::rec.fld', 'FIELD_WRITE' FROM f UNION ALL SELECT 'variable:src/s' || k || '.c::rec', 'member:src/s' || k || '.c::rec.other', 'FIELD_READ' FROM f""",
)
def g4_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(
    "g4_program_nodes",
    _REACHED
    + """ SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'file' AS kind FROM f UNION ALL SELECT 'file' FROM h UNION ALL SELECT 'function' FROM f UNION ALL SELECT 'variable' FROM f, (SELECT unnest([1, 2, 3, 4])) UNION ALL SELECT 'member' FROM f, (SELECT unnest([1, 2]))
 UNION ALL SELECT 'header' UNION ALL SELECT DISTINCT 'header' || '' FROM h WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = CAST(floor(k / 3) AS INT)) UNION ALL SELECT 'external' UNION ALL SELECT DISTINCT 'external' || '' FROM f WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = CAST(floor(k / 2) AS INT))) GROUP BY kind""",
)
def g4_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_W = r"list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t-\r]+'), lambda w: w <> ''))"


@query(
    "j27_many_searches",
    rf"""WITH n AS (SELECT doc_id, unnest({_W}) AS w FROM documents), q AS (SELECT item_id, {_W} AS ws FROM benchmark), qw AS (SELECT item_id, len(ws) AS size, unnest(ws) AS w FROM q),
 s AS (SELECT item_id, doc_id, CAST(count(*) AS INTEGER) AS hits, any_value(size) AS size FROM qw JOIN n USING (w) GROUP BY item_id, doc_id)
 SELECT item_id AS query_id, doc_id AS entry_id, hits, round(hits / size::DOUBLE, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def j27(spark, sf_dir):
    path = search.write_index(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("content")))
    found = search.search(spark, path, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return found.withColumn("score", F.round("score", 9))


#: rules from parts, plain ones and, one in a hundred, expressions; texts from orders name three parts
_RULES = "'agent' || p_brand AS target, p_size AS priority, p_partkey AS ord, CASE WHEN p_partkey % 100 = 7 THEN '^order ' || p_partkey || '[05]*\\b' ELSE 'Part <' || p_partkey || '>' END AS pattern"
_TEXT = "'order ' || o_orderkey || ': part <' || (o_orderkey * 7 % 2300) || '>, PART <' || (o_custkey * 3 % 2100) || '>, part <' || (o_orderkey % 1999) || '>.'"


@query(
    "c12_rules_by_priority",
    f"""WITH r AS (SELECT {_RULES}, p_partkey % 100 = 7 AS expression FROM part), t AS (SELECT o_orderkey AS k, {_TEXT} AS text FROM orders)
 SELECT k, coalesce(arg_min(target, 1000000 * (100 - priority) + ord) FILTER (WHERE target IS NOT NULL), 'nobody') AS target FROM t LEFT JOIN r ON CASE WHEN expression THEN regexp_matches(text, pattern, 'i') ELSE contains(lower(text), lower(pattern)) END GROUP BY k""",
)
def c12(spark, sf_dir):
    rules = read(spark, sf_dir, "part").selectExpr(*_RULES.replace("\\b", "\\\\b").split(", ", 3))
    texts = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", _TEXT + " AS text")
    return automaton.routed(texts, rules, "text", "nobody").select("k", "target")


@query("a17_chunk_counts", ST + r" SELECT file_id, upper(regexp_extract(sql_text, '^EXEC SQL (\w+)', 1)) AS keyword, CAST(count(*) AS BIGINT) AS n FROM st WHERE sql_text NOT LIKE 'EXEC SQL FOR%' GROUP BY ALL")
def a17(spark, sf_dir):
    chunks = scan_files(source_texts(spark, sf_dir), "chunk", size=400, overlap=60, near=40)
    return chunked.chunk_counts(chunks)


@query("u5_extensions_in_sql", ST + r""" SELECT file_id, 'block' AS kind, lower(regexp_extract(sql_text, '^EXEC SQL (\w+)', 1)) AS name, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY ALL
 UNION ALL SELECT file_id, 'run', first_word, CAST(max(len) AS BIGINT) FROM (SELECT file_id, first_word, count(*) AS len FROM (SELECT file_id, line_start, regexp_extract(sql_text, '^EXEC SQL (\w+)', 1) AS first_word, row_number() OVER (PARTITION BY file_id ORDER BY line_start) - row_number() OVER (PARTITION BY file_id, regexp_extract(sql_text, '^EXEC SQL (\w+)', 1) ORDER BY line_start) AS g FROM st) GROUP BY file_id, first_word, g) GROUP BY file_id, first_word""")
def u5(spark, sf_dir):
    """A scanner and a relationship by name, the one joined laterally, the other over a partitioned table."""
    held = extensions.Extensions()

    @held.relationship("longest_runs", "file_id long, name string, n long")
    def runs(rows):
        best: dict[str, int] = {}
        last, length = None, 0
        for r in rows:
            length = length + 1 if r.word == last else 1
            last = r.word
            best[last] = max(best.get(last, 0), length)
        for word, n in best.items():
            yield {"file_id": rows[0].file_id, "name": word, "n": n}

    held.install(spark)
    sources = source_texts(spark, sf_dir)
    words = statements(spark, sf_dir).selectExpr("file_id", "line_start", r"regexp_extract(sql_text, '^EXEC SQL (\\w+)', 1) AS word")
    blocks = spark.sql(r"SELECT file_id, 'block' AS kind, lower(regexp_extract(b.raw, '^EXEC SQL (\\w+)', 1)) AS name, count(*) AS n FROM {files}, LATERAL scan_sql(content) AS b GROUP BY ALL", files=sources)
    return blocks.unionByName(spark.sql("SELECT file_id, 'run' AS kind, name, n FROM longest_runs(TABLE(SELECT * FROM {words}) PARTITION BY file_id ORDER BY line_start)", words=words))


@query("u2_variable_rules", ST + r", v AS (SELECT line_start, unnest(regexp_extract_all(sql_text, ':[A-Za-z_]\w*(?:\.\w+)?')) AS x FROM st) SELECT line_start, CASE WHEN x LIKE '%.%' THEN 'member=' ELSE 'plain=' END || x AS variable, CAST(count(*) AS BIGINT) AS n FROM v WHERE NOT (x LIKE ':ind%') GROUP BY ALL")
def u2(spark, sf_dir):
    rule = extensions.VariableRule
    held = extensions.Extensions().variable_rule(rule("plain", r"(?<!\w):[A-Za-z_]\w*")).variable_rule(rule("member", r":[A-Za-z_]\w*\.\w+"))
    return held.variables(statements(spark, sf_dir), "sql_text").select("line_start", F.explode("variables").alias("variable")).groupBy("line_start", "variable").agg(F.count(F.lit(1)).alias("n"))
