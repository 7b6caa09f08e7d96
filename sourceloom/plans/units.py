"""Registered queries of single operators over texts and rows made from the tables, with checking SQL.

An input that both engines can make from one expression is written once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hostvars as hv
from ..functions import rewrite as rw
from ..functions import rules, text
from ..functions.corpus import statements
from ..operators import builds, checks, context, graphs, java, relations
from ..operators.scanner import scan_files
from ..sources import files, formats, sinks
from ..storage import shared_dir, stored
from .inventory import FI, HE, headers
from .inventory import files as programs
from .queries import ORACLES, PLAIN, ST, TYPED, query, read, typed

NL, Q = "chr(10)", "chr(39)"


def rows_of(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, table).selectExpr(*columns)


def folder(spark: SparkSession) -> str:
    """A new folder of the shared one, for files that are written and read again."""
    return f"{shared_dir(spark)}/units-{uuid.uuid4().hex}"


# ---- files, read back from what was written


@query("s4_pairs_read_back", f"SELECT 'c' || o_custkey || '.yaml' AS file, o_orderkey AS idx, concat('SELECT ', o_orderstatus, {NL}, '  FROM t: ', o_orderpriority, ';') AS sql, concat('SELECT #', o_orderkey) AS parsed_sql, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE '' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN concat('said: {chr(34)}', o_orderpriority, '{chr(34)} # ', o_orderkey) ELSE '' END AS comment FROM orders")
def s4(spark, sf_dir):
    """Reviewed pairs are exported as a YAML file for each customer (S18) and loaded again."""
    items = rows_of(spark, sf_dir, "orders", "concat('c', o_custkey) AS file", "o_orderkey AS idx", f"concat('SELECT ', o_orderstatus, {NL}, '  FROM t: ', o_orderpriority, ';') AS sql", "concat('SELECT #', o_orderkey) AS parsed_sql", "if(o_orderkey % 3 = 0, 'approved', null) AS status", "if(o_orderkey % 4 = 0, concat('said: \"', o_orderpriority, '\" # ', o_orderkey), null) AS comment")
    path = folder(spark)
    sinks.write_items(items, path, folders=1024)
    formats.register(spark)
    back = spark.read.format("conversion_pairs").load(path)
    entry = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    return back.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), entry("idx").cast("long").alias("idx"), "sql", "parsed_sql", entry("status").alias("status"), entry("comment").alias("comment"))


@query("s1_source_trees", FI + " SELECT 'd' || file_id % 7 || '/f' || file_id || CASE WHEN file_id % 2 = 0 THEN '.pc' ELSE '.h' END AS path, content, CAST(strlen(content) AS BIGINT) AS size FROM fi WHERE file_id % 5 > 0")
def s1(spark, sf_dir):
    """Sources written one by one; those with other suffixes are not read."""
    kind = F.expr("case when file_id % 5 = 0 then '.txt' when file_id % 2 = 0 then '.pc' else '.h' end")
    path = folder(spark)
    sinks.write_texts(programs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("file_id") % 7, F.lit("/f"), "file_id", kind).alias("name"), "content"), path)
    formats.register(spark)
    back = spark.read.format("source_tree").load(path).where("error is null")
    return back.select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("path"), "content", "size")


@query("s6_checklists", "SELECT 'n' || s_nationkey || '.yaml' AS file, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS ordinal, s_name AS name, 'is ' || s_suppkey || ': kept?' AS item FROM supplier")
def s6(spark, sf_dir):
    one = F.expr("concat('    - name: \"', s_name, '\"\n      check: \"is ', s_suppkey, ': kept?\"\n')")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("t")))), lambda x: x["t"]), "")
    texts = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("title: x\nstages:\n  sql:\n"), listed).alias("content"))
    path = folder(spark)
    sinks.write_texts(texts.select(F.concat(F.lit("n"), "s_nationkey", F.lit(".yaml")).alias("name"), "content"), path)
    formats.register(spark)
    back = spark.read.format("yaml_checklist").option("key", "stages.sql").load(path)
    return back.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "ordinal", "name", "item")


@query("s5_sessions", "SELECT CAST(s_suppkey AS INTEGER) AS idx, CASE WHEN s_suppkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS comment FROM supplier")
def s5(spark, sf_dir):
    path = folder(spark)
    sinks.write_session(rows_of(spark, sf_dir, "supplier", "s_suppkey AS idx", "if(s_suppkey % 2 = 0, 'approved', 'rejected') AS status", "if(s_suppkey % 3 = 0, s_name, null) AS comment"), path)
    return files.session_items(spark, path)


@query("s12_elements_by_type", FI + " SELECT 'function' AS type, 'fn_' || file_id AS name FROM fi UNION ALL SELECT 'variable', unnest(['g_count', 'h_name', 'h_' || file_id, 's_total', 'loc', 'hits']) FROM fi")
def s12(spark, sf_dir):
    """Elements as JSON lines, a folder for each type, read back with the type from the folder (A1)."""
    path = folder(spark)
    elements = scan_files(programs(spark, sf_dir), "c", fields=("kind", "name", "line_start"))
    sinks.write_elements(elements.withColumnRenamed("kind", "type").select("type", "name", "line_start"), path)
    return spark.read.json(path).select("type", "name")


@query("s15_graph_records", """SELECT '{"record_type":"node","id":"n' || c_custkey || '","name":"' || c_name || '"}' AS value FROM customer UNION ALL SELECT '{"record_type":"edge","source_id":"n' || c_custkey || '","target_id":"n' || c_nationkey || '","edge_type":"IN"}' FROM customer""")
def s15(spark, sf_dir):
    nodes = rows_of(spark, sf_dir, "customer", "concat('n', c_custkey) AS id", "c_name AS name")
    return sinks.graph_records(nodes, rows_of(spark, sf_dir, "customer", "concat('n', c_custkey) AS source_id", "concat('n', c_nationkey) AS target_id", "'IN' AS edge_type"))


@query("s15_dot_lines", """SELECT 0 AS ord, 'digraph g {' AS value UNION ALL SELECT 1, '  "n' || c_custkey || '" [label="' || replace(c_mktsegment, 'I', chr(92) || chr(34)) || '"];' FROM customer UNION ALL SELECT 2, '  "n' || c_custkey || '" -> "n' || c_nationkey || '" [label="IN"];' FROM customer UNION ALL SELECT 3, '}'""")
def s15_dot(spark, sf_dir):
    nodes = rows_of(spark, sf_dir, "customer", "concat('n', c_custkey) AS id", "replace(c_mktsegment, 'I', chr(34)) AS name")
    return sinks.dot_lines(nodes, rows_of(spark, sf_dir, "customer", "concat('n', c_custkey) AS source_id", "concat('n', c_nationkey) AS target_id", "'IN' AS edge_type"))


@query("s17_merge_cypher", f"""SELECT 0 AS ord, concat('MERGE (n:Customer {{id: ', {Q}, 'n', c_custkey, {Q}, '}}) SET n.name = ', {Q}, 'it', chr(92), {Q}, 's ', c_name, {Q}, ';') AS value FROM customer UNION ALL SELECT 1, concat('MATCH (a {{id: ', {Q}, 'n', c_custkey, {Q}, '}}), (b {{id: ', {Q}, 'n', c_nationkey, {Q}, '}}) MERGE (a)-[:IN]->(b);') FROM customer""")
def s17(spark, sf_dir):
    nodes = rows_of(spark, sf_dir, "customer", "concat('n', c_custkey) AS id", f"concat('it', {Q}, 's ', c_name) AS name", "'Customer' AS node_type")
    return sinks.cypher_statements(nodes, rows_of(spark, sf_dir, "customer", "concat('n', c_custkey) AS source_id", "concat('n', c_nationkey) AS target_id", "'IN' AS link_type"), merge=True)


@query("s19_report_page", """SELECT '<html><head><title>Checks</title></head><body><table>' || string_agg('<tr><td>' || s_name || '</td><td class="' || CASE WHEN s_suppkey % 2 = 0 THEN 'pass' ELSE 'fail' END || '">' || CASE WHEN s_suppkey % 2 = 0 THEN 'pass' ELSE 'fail' END || '</td><td>' || s_suppkey || ' &lt; 9 &amp; more</td></tr>', '' ORDER BY s_name) || '</table></body></html>' AS html FROM supplier""")
def s19(spark, sf_dir):
    return sinks.report_html(rows_of(spark, sf_dir, "supplier", "s_name AS name", "if(s_suppkey % 2 = 0, 'pass', 'fail') AS status", "concat(s_suppkey, ' < 9 & more') AS message"), "Checks")


@query("s19_report_lines", """SELECT 1 AS ord, c_name AS name, '<tr><td>' || c_name || '</td><td class="' || c_mktsegment || '">' || c_mktsegment || '</td><td>&lt;' || c_custkey || '&gt;</td></tr>' AS value FROM customer UNION ALL SELECT 0, '', '<html><head><title>All</title></head><body><table>' UNION ALL SELECT 2, '', '</table></body></html>'""")
def s19_lines(spark, sf_dir):
    return sinks.report_lines(rows_of(spark, sf_dir, "customer", "c_name AS name", "c_mktsegment AS status", "concat('<', c_custkey, '>') AS message"), "All")


_STRUCTS = f"concat('#define N ', p_size, {NL}, 'typedef struct {{', {NL}, '  int  k_no;  /* the key */', {NL}, '  char p_nm[ N + 1];', {NL}, '  long amt_x;', {NL}, '}} rec', p_partkey, '_t;', {NL}, 'rec', p_partkey, '_stp[] = {{ {{', {Q}, 'w', {Q}, ', 1, 0, 0}}, {{', {Q}, 'i', {Q}, ', 4, 0, 0}}, {{', {Q}, 's', {Q}, ', 3, 0, 0}}, {{', {Q}, 'd', {Q}, ', ', p_size + 2, ', 2, 0}}, {{', {Q}, '0', {Q}, ', 0, 0, 0}} }};', {NL})"


@query(
    "b12_struct_fields",
    "SELECT 'rec' || p_partkey || '_t' AS struct_name, k AS ordinal, name, dtype, CASE k WHEN 0 THEN 4 WHEN 1 THEN p_size + 1 ELSE p_size + 2 END AS size, CASE k WHEN 2 THEN 2 ELSE 0 END AS decimal, CASE k WHEN 0 THEN 'the key' ELSE '' END AS description, CASE k WHEN 1 THEN p_size + 1 ELSE -1 END AS array_size FROM part, (VALUES (0, 'k_no', 'int'), (1, 'p_nm', 'char'), (2, 'amt_x', 'long')) v(k, name, dtype)",
)
def b12(spark, sf_dir):
    """Fields of structs with the sizes of their transport arrays (B13, J11, K10) and macros."""
    found = scan_files(rows_of(spark, sf_dir, "part", "p_partkey AS file_id", f"{_STRUCTS} AS content"), "header")
    return found.select("struct_name", "ordinal", "name", "dtype", "size", "decimal", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("array_size", F.lit(-1)).alias("array_size"))


@query(
    "s20_descriptors",
    """SELECT 'rec' || p_partkey || '_t' AS struct_name, 'OMM Rec' || p_partkey || chr(13) || chr(10) || '{' || chr(13) || chr(10) || '	Integer kNo<length=4 description="the key">;' || chr(13) || chr(10) || '	String pNm<length=' || (p_size + 1) || ' description="p_nm">;' || chr(13) || chr(10) || '	BigDecimal amtX<length=' || (p_size + 2) || ' decimal=2 description="amt_x">;' || chr(13) || chr(10) || '}' || chr(13) || chr(10) AS text FROM part""",
)
def s20(spark, sf_dir):
    fields = ("struct_name", "ordinal", "name", "dtype", "size", "decimal", "description")
    return sinks.omm_texts(scan_files(rows_of(spark, sf_dir, "part", "p_partkey AS file_id", f"{_STRUCTS} AS content"), "header", fields=fields))


# ---- scanners


@query("b6_directives", HE + " SELECT file_id, 'include' AS kind, 'h' || CAST(floor(CAST(regexp_extract(file_id, '\\d+') AS INT) / 3) AS INT) || '.h' AS name, 'local' AS value, CAST(1 AS BIGINT) AS line_start FROM he UNION ALL SELECT file_id, 'include', 'stdio.h', 'system', 2 FROM he UNION ALL SELECT 'h' || s_suppkey || '.h', 'macro', 'LIMIT_' || s_suppkey, '(s_total + ' || s_nationkey || ')', 3 FROM supplier")
def b6(spark, sf_dir):
    return scan_files(headers(spark, sf_dir), "directive").select("file_id", "kind", "name", "value", "line_start")


@query("b7_macro_calls", "SELECT o_orderkey AS k, unnest(['a, ' || o_orderkey, '', 'f(x), y']) AS args FROM orders")
def b7(spark, sf_dir):
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", "concat('BAMCALL( a, ', o_orderkey, ' ); g(BAM); BAMCALL(); x = 1; BAMCALL (f(x), y) ;') AS t")
    return t.select("k", F.explode(text.macro_calls(F.col("t"))).alias("args")).withColumn("args", F.trim("args"))


@query("b17_java_methods", "SELECT o_orderkey AS k, name, raw FROM (SELECT o_orderkey, unnest(['run' || o_orderkey, 'get']) AS name, unnest(['  public int run' || o_orderkey || '(int a) { String s = \"} {\"; /* } */ return ' || o_orderkey || '; }', '  static List<String> get() throws E { if (x) { y(); } }']) AS raw FROM orders)")
def b17(spark, sf_dir):
    """Methods with strings and comments that hold braces."""
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", "concat('class A {\n  int x = 1;\n  public int run', o_orderkey, '(int a) { String s = \"} {\"; /* } */ return ', o_orderkey, '; }\n  static List<String> get() throws E { if (x) { y(); } }\n}') AS content")
    schema = "k long, name string, raw string"

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(k, name, raw) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for name, raw in java.methods(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["k", "name", "raw"])

    return t.mapInArrow(found, schema)


ORACLES["b16_chunks"] = """WITH d AS (SELECT doc_id, length(text) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, CAST(1 + ceil(greatest(n - 4000, 0) / 3800.0) AS BIGINT))) AS chunk FROM d WHERE n > 0)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 3800 AS BIGINT) AS start, CAST(least(chunk * 3800 + 4000, n) AS BIGINT) AS "end" FROM c"""  # texts without a statement's end


# ---- rules and variables


@query("c7_header_types", "SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 5 THEN 'system' ELSE list_extract(['stp', 'struct', 'macro', 'function', 'mixed'], CAST(p_partkey % 6 + 1 AS INT)) END AS header_type FROM part")
def c7(spark, sf_dir):
    kinds = f"element_at(array(concat('typedef struct {{ int a; }} r', p_partkey, '_t;{chr(92)}nr_stp[] = {{}};'), concat('typedef struct {{ int a; }} r', p_partkey, '_t;'), concat('#define A', p_partkey, ' 1'), concat('extern int f', p_partkey, '(int);'), concat('#define A ', p_partkey, '{chr(92)}nint f(void);'), '#define B 2'), cast(p_partkey % 6 + 1 as int))"
    t = rows_of(spark, sf_dir, "part", "p_partkey AS k", f"{kinds} AS t", "if(p_partkey % 6 = 5, concat('inc', p_partkey, '/stdio.h'), concat('h', p_partkey, '.h')) AS path")
    return t.select("k", rules.header_type(F.col("t"), F.col("path")).alias("header_type"))


@query("c19_in_literal", "SELECT o_orderkey AS k, o_orderkey % 3 = 1 AS inside FROM orders")
def c19(spark, sf_dir):
    before = f"concat('x = ', repeat({Q}, cast(o_orderkey % 3 as int)), o_orderpriority)"
    return rows_of(spark, sf_dir, "orders", "o_orderkey AS k", f"{before} AS t").select("k", text.in_literal(F.col("t")).alias("inside"))


@query("v5_inputs_by_value", ST + rf", v AS (SELECT line_start, regexp_extract_all(sql_text, '{PLAIN}') AS h, regexp_extract_all(regexp_extract(sql_text, '(?i)\bINTO (:.*?)(?: FROM|;)', 1), '{PLAIN}') AS o FROM st) SELECT line_start, CAST(len(list_filter(h, lambda x: NOT list_contains(o, x))) AS BIGINT) AS n FROM v")
def v5(spark, sf_dir):
    kind = rules.sql_type(F.col("sql_text"))
    return statements(spark, sf_dir).select("line_start", F.size(hv.inputs_by_value(F.col("sql_text"), kind)).cast("long").alias("n"))


@query("v7_masked_literals", f"SELECT o_orderkey AS k, concat('a = ', {Q}, {Q}, ' AND b = :v', o_orderkey, ' AND c = ', {Q}, {Q}) AS sql FROM orders")
def v7(spark, sf_dir):
    t = f"concat('a = ', {Q}, o_orderpriority, {Q}, {Q}, 's :no', {Q}, ' AND b = :v', o_orderkey, ' AND c = ', {Q}, {Q})"
    return rows_of(spark, sf_dir, "orders", "o_orderkey AS k", f"{t} AS t").select("k", hv.masked(F.col("t")).alias("sql"))


@query("v7_protected_times", f"SELECT o_orderkey AS k, concat('TO_CHAR(d, ', {Q}, 'HH24#MI', {Q}, ') = :t', o_orderkey, ' AND x = ', {Q}, '12#30', {Q}) AS sql FROM orders")
def v7_times(spark, sf_dir):
    t = f"concat('TO_CHAR(d, ', {Q}, 'HH24:MI', {Q}, ') = :t', o_orderkey, ' AND x = ', {Q}, '12:30', {Q})"
    return rows_of(spark, sf_dir, "orders", "o_orderkey AS k", f"{t} AS t").select("k", F.replace(text.protected_times(F.col("t")), F.lit("\u0001"), F.lit("#")).alias("sql"))


# ---- texts


@query("n9_returning_aliases", "SELECT o_orderkey AS k, concat('INSERT INTO t VALUES (', o_orderkey, ') RETURNING id AS newId, f(a, ', o_orderkey, ') AS hA', o_orderkey % 4) AS sql FROM orders")
def n9(spark, sf_dir):
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", "concat('INSERT INTO t VALUES (', o_orderkey, ') RETURNING id, f(a, ', o_orderkey, ') INTO :new_id, :h_a', o_orderkey % 4, ';') AS t")
    return t.select("k", text.returning_aliases(F.col("t")).alias("sql"))


@query("n12_split_arguments", f"SELECT o_orderkey AS k, unnest(['buf', '\"a, ' || o_orderkey || '\"', 'f(x, ' || o_orderkey % 5 || ')', chr(39) || ',' || chr(39)]) AS argument FROM orders")
def n12(spark, sf_dir):
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", f"concat('buf, \"a, ', o_orderkey, '\",f(x, ', o_orderkey % 5, '), ', {Q}, ',', {Q}) AS t")
    return t.select("k", F.explode(text.split_arguments(F.col("t"))).alias("argument"))


@query("n15_host_names", "SELECT p_partkey AS k, 'part' || p_partkey || 'No' AS camel, 'Part' || p_partkey || 'No' AS upper_first, 'part_' || p_partkey || '_no' AS kept, 'Part' || p_partkey || 'Rec' AS class, 'part' || p_partkey || 'No,x' AS listed FROM part")
def n15(spark, sf_dir):
    t = rows_of(spark, sf_dir, "part", "concat(':part_', p_partkey, '_no:ind') AS v", "p_partkey AS k", "concat('part_', p_partkey, '_rec_t') AS s")
    v = F.col("v")
    return t.select("k", rw.host_name(v).alias("camel"), rw.host_name(v, first_upper=True).alias("upper_first"), rw.host_name(v, keep=True).alias("kept"), rw.class_name(F.col("s")).alias("class"), F.array_join(rw.host_names(F.array(v, F.lit(":x[1]"), v)), ",").alias("listed"))


@query("n14_digits_in_names", "SELECT p_partkey AS k, 'ab' || p_partkey % 10 || 'Xy' || p_partkey AS titled, 'ab' || p_partkey % 10 || 'xy' || p_partkey AS capitalised FROM part")
def n14(spark, sf_dir):
    """The two forms differ after digits: ab_1xy becomes ab1Xy by title case, ab1xy by capitalising."""
    name = F.col("t")
    return rows_of(spark, sf_dir, "part", "p_partkey AS k", "concat('AB_', p_partkey % 10, 'XY', p_partkey) AS t").select("k", rw.camel(name).alias("titled"), rw.camel(name, title=False).alias("capitalised"))


@query("n16_ids_go_on", TYPED + """, o AS (SELECT * FROM ty WHERE line_start % 2 = 0), w AS (SELECT * FROM ty WHERE line_start % 2 = 1), i AS (SELECT file_id, count(*) AS n FROM o GROUP BY file_id), k AS (SELECT file_id, sql_type, count(*) AS n FROM o GROUP BY ALL)
 SELECT line_start, 'sql_' || lpad(CAST(row_number() OVER (PARTITION BY w.file_id ORDER BY line_start) + coalesce(i.n, 0) AS VARCHAR), 3, '0') AS sql_id, w.sql_type || '_' || (row_number() OVER (PARTITION BY w.file_id, w.sql_type ORDER BY line_start) - 1 + coalesce(k.n, 0)) AS sql_name FROM w LEFT JOIN i ON i.file_id = w.file_id LEFT JOIN k ON k.file_id = w.file_id AND k.sql_type = w.sql_type""")
def n16(spark, sf_dir):
    """Statements that come later go on where the first ones ended."""
    st = typed(spark, sf_dir)
    later = relations.statement_ids(st.where("line_start % 2 = 1"), relations.next_ids(st.where("line_start % 2 = 0")))
    return later.select("line_start", "sql_id", "sql_name")


@query("n18_typed_parameters", "SELECT o_orderkey AS k, 'x &lt; #{hVal' || o_orderkey % 9 || '}' AS sql FROM orders")
def n18(spark, sf_dir):
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", "concat('x < ', ':h_val', o_orderkey % 9) AS t")
    return t.select("k", F.concat(rw.xml_escape(F.lit("x < ")), rw.default_input(F.regexp_extract("t", r"(:\w+)", 1))).alias("sql"))


@query("n20_safe_ids", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'part__' || p_partkey || '_x' ELSE '_' || p_partkey || 'a' END AS id, CAST(50 AS INT) AS long_size FROM part")
def n20(spark, sf_dir):
    t = rows_of(spark, sf_dir, "part", "p_partkey AS k", "if(p_partkey % 2 = 0, concat('part::', p_partkey, '-x'), concat(p_partkey, 'a')) AS t")
    return t.select("k", rw.safe_id(F.col("t")).alias("id"), F.length(rw.safe_id(F.concat(F.repeat(F.lit("y"), 60), "t"))).alias("long_size"))


@query("n21_json_blocks", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE '{\"a\": {\"b\": ' || o_orderkey || '}}' END AS json FROM orders")
def n21(spark, sf_dir):
    t = "case o_orderkey % 3 when 0 then concat('so:\n```json\n{\"a\": {\"b\": ', o_orderkey, '}}\n```\nend') when 1 then concat('text {\"a\": {\"b\": ', o_orderkey, '}} more') else 'none' end"
    return rows_of(spark, sf_dir, "orders", "o_orderkey AS k", f"{t} AS t").select("k", F.coalesce(rw.json_block(F.col("t")), F.lit("")).alias("json"))


@query("n22_rendered", "SELECT o_orderkey AS k, concat('order ', o_orderkey, ' is ', o_orderstatus, ', ', o_orderstatus, '; ${other}') AS text FROM orders")
def n22(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus")).alias("v"))
    return t.select("k", rw.rendered(F.lit("order ${id} is ${status}, ${status}; ${other}"), F.col("v")).alias("text"))


@query("h6_mysql_to_oracle", f"SELECT o_orderkey AS k, concat('SELECT NVL(a, SYSDATE), ', {Q}, 'NOW() LIMIT 3', {Q}, ', TRUNC(SYSDATE) FROM t WHERE b = ', o_orderkey) AS sql FROM orders")
def h6(spark, sf_dir):
    t = f"concat('SELECT IFNULL(a, NOW()), ', {Q}, 'NOW() LIMIT 3', {Q}, ', CURDATE() FROM t WHERE b = ', o_orderkey, if(o_orderkey % 2 = 0, ' LIMIT 5', concat(' LIMIT 5 OFFSET ', o_orderkey)))"
    return rows_of(spark, sf_dir, "orders", "o_orderkey AS k", f"{t} AS t").select("k", rw.DIALECTS["mysql", "oracle"](F.col("t")).alias("sql"))


@query("h9_row_limits", """SELECT o_orderkey AS k, 'SELECT * FROM (SELECT a.*, ROWNUM rn FROM (SELECT ' || o_orderkey || ' FROM t) a WHERE ROWNUM <= :o + :l) WHERE rn > :o' AS legacy, 'SELECT ' || o_orderkey || ' FROM t OFFSET :o ROWS FETCH NEXT :l ROWS ONLY' AS later, 'SELECT * FROM (SELECT a.*, ROW_NUMBER() OVER () AS rn FROM (SELECT ' || o_orderkey || ' FROM t) AS a) AS b WHERE rn > :o AND rn <= :o + :l' AS db2 FROM orders""")
def h9(spark, sf_dir):
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", "concat('SELECT ', o_orderkey, ' FROM t') AS t")
    form = lambda dbms: rw.paged(F.col("t"), dbms, ":o", ":l")
    return t.select("k", form("oracle").alias("legacy"), form("oracle12").alias("later"), form("db2").alias("db2"))


# ---- joins and summaries


@query("j9_last_plugin_wins", "SELECT o_orderkey AS line_start, CASE WHEN o_orderkey % 2 = 0 THEN 'txn' || o_custkey WHEN o_orderkey % 3 = 0 THEN 'cur' || o_custkey ELSE '' END AS relationship_id FROM orders")
def j9(spark, sf_dir):
    st = rows_of(spark, sf_dir, "orders", "o_custkey AS file_id", "o_orderkey AS line_start")
    member = lambda where, name, order: st.where(where).select("file_id", "line_start", F.concat(F.lit(name), "file_id").alias("relationship_id"), F.lit(order).alias("plugin_order"), F.lit(1).alias("sequence"), F.lit(1).alias("total"))
    out = relations.write_back(st, member("line_start % 3 = 0", "cur", 0).unionByName(member("line_start % 2 = 0", "txn", 2)))
    return out.select("line_start", F.coalesce("relationship.relationship_id", F.lit("")).alias("relationship_id"))


@query("j10_macro_sizes", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'M' ELSE CAST(o_custkey AS VARCHAR) END || ',' || o_orderkey || ',OTHER' AS sizes FROM orders")
def j10(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    variables = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("k"), F.array(F.lit("M"), F.col("o_orderkey").cast("string"), F.lit("OTHER")).alias("array_sizes"))
    macros = o.where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("file_id"), F.lit("M").alias("name"), F.col("o_custkey").cast("string").alias("value")).distinct()
    return relations.macro_sizes(variables, macros).select("k", F.array_join("resolved_array_sizes", ",").alias("sizes"))


@query("j12_count_fields", "SELECT 's' || p_partkey AS struct_name, CASE p_partkey % 4 WHEN 0 THEN 'rec_count' WHEN 1 THEN 'rec_cnt' WHEN 2 THEN 'recCnt' ELSE '' END AS count_field FROM part")
def j12(spark, sf_dir):
    t = rows_of(spark, sf_dir, "part", "concat('s', p_partkey) AS struct_name", "explode(array('rec', element_at(array('rec_count', 'rec_cnt', 'recCnt', 'other'), cast(p_partkey % 4 + 1 as int)))) AS name")
    return context.count_fields(t.withColumn("array_size", F.when(F.col("name") == "rec", 5))).select("struct_name", F.coalesce("count_field", F.lit("")).alias("count_field"))


_RUNG = "CASE p_partkey % 5 WHEN 0 THEN 'partNo' WHEN 1 THEN 'PARTNO' WHEN 2 THEN 'H_part_no' WHEN 3 THEN 'w_partNo' ELSE 'i_PARTNO' END"


@query("j13_every_rung", f"SELECT 'a' || p_partkey AS source_id, 'b' || p_partkey AS target_id, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence, list_extract(['exact', 'lower', 'stripped_camel', 'stripped', 'stripped_lower'], CAST(p_partkey % 5 + 1 AS INT)) AS rule FROM part")
def j13(spark, sf_dir):
    """Each rung of the ladder, within a struct."""
    left = rows_of(spark, sf_dir, "part", "concat('a', p_partkey) AS id", f"{_RUNG} AS name", "p_partkey AS struct")
    right = rows_of(spark, sf_dir, "part", "concat('b', p_partkey) AS id", "'partNo' AS name", "p_partkey AS struct")
    return graphs.name_links(left, right, "MAPPED_TO", "struct").select("source_id", "target_id", "confidence", "rule")


@query("j20_data_flow", "SELECT o_orderkey AS file_id, unnest(['b' || o_orderkey, 'c']) AS source, 'a' AS target FROM orders")
def j20(spark, sf_dir):
    o = rows_of(spark, sf_dir, "orders", "o_orderkey AS file_id", "'a' AS target", "concat('b', o_orderkey, ' + f(c) * a + zz') AS expression")
    known = rows_of(spark, sf_dir, "orders", "o_orderkey AS file_id", "explode(array('a', concat('b', o_orderkey), 'c', 'd')) AS name")
    return graphs.word_edges(o, known)


@query("j21_chain_edges", "SELECT o_orderkey AS file_id, unnest(['a', 'b' || o_orderkey % 7]) AS target, unnest(['b' || o_orderkey % 7, o_orderstatus]) AS source FROM orders")
def j21(spark, sf_dir):
    return context.chain_edges(rows_of(spark, sf_dir, "orders", "o_orderkey AS file_id", "concat('a = b', o_orderkey % 7, ' = ', o_orderstatus) AS statement"))


@query("j22_field_accesses", "SELECT o_orderkey AS file_id, unnest(['r', 'p', 'r']) AS struct, unnest(['f' || o_orderkey % 5, 'g', 'h']) AS field, unnest(['write', 'read', 'read']) AS access, unnest([false, true, false]) AS is_pointer FROM orders")
def j22(spark, sf_dir):
    return context.field_accesses(rows_of(spark, sf_dir, "orders", "o_orderkey AS file_id", "concat('r.f', o_orderkey % 5, ' = p->g; if (r.h == 1) x();') AS content"))


@query("j24_resolved_headers", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'd' || o_custkey || '/h.h' WHEN 1 THEN 'inc/g.h' ELSE '' END AS path FROM orders")
def j24(spark, sf_dir):
    o = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", "concat('d', o_custkey) AS source_dir", "element_at(array('h.h', 'g.h', 'none.h'), cast(o_orderkey % 3 + 1 as int)) AS name")
    listing = rows_of(spark, sf_dir, "orders", "explode(array(concat('d', o_custkey, '/h.h'), 'inc/h.h', 'inc/g.h', 'late/g.h')) AS path").distinct()
    return graphs.resolved_includes(o, listing, ["inc", "late"]).select("k", F.coalesce("path", F.lit("")).alias("path"))


@query("j25_exported_items", "SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '' END AS analysis FROM orders")
def j25(spark, sf_dir):
    items = rows_of(spark, sf_dir, "orders", "o_orderkey AS idx", "o_orderkey AS sql")
    out = context.exported(items, rows_of(spark, sf_dir, "orders", "o_orderkey AS idx", "o_orderstatus AS status").where("idx % 2 = 0"), rows_of(spark, sf_dir, "orders", "o_orderkey AS idx", "o_orderpriority AS analysis").where("idx % 5 = 0"))
    return out.select("idx", "status", F.coalesce("analysis", F.lit("")).alias("analysis"))


ORACLES["j26_function_contexts"] = TYPED + f""", i AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_start) - 1 AS k FROM ty)
SELECT file_id, 'f' || line_start AS function, '## f' || line_start || {NL} || 'f' || line_start || ': 1 variables, 1 statements, 1 calls' || {NL} || '- ' || (5 * k + 3) || ' ' || sql_type AS text FROM i"""

@query("k11_prompt_forms", """SELECT c_custkey AS file_id, 'fn_' || c_custkey AS function, '[FUNC]fn_' || c_custkey || ' ' || l || '-' || l + 4 + c_custkey % 3 || chr(10) || '[VARS]int hits;int loc' || chr(10) || '[SQL:select]' || l + 3 + c_custkey % 3 AS compact,
 '<function name="fn_' || c_custkey || '" from="' || l || '" to="' || l + 4 + c_custkey % 3 || '">' || chr(10) || '  <variables>' || chr(10) || '    <variable type="int" name="hits"/>' || chr(10) || '    <variable type="int" name="loc"/>' || chr(10) || '  </variables>' || chr(10) || '  <statements>' || chr(10) || '    <statement line="' || l + 3 + c_custkey % 3 || '" type="select"/>' || chr(10) || '  </statements>' || chr(10) || '</function>' AS xml
 FROM (SELECT *, c_custkey % 5 + 7 AS l FROM customer)""")
def k11(spark, sf_dir):
    """Compact and XML forms of each function's context."""
    f = programs(spark, sf_dir)
    c = stored(scan_files(f, "c"))  # read more than once
    fns = c.where("kind = 'function'").select("file_id", "name", "line_start", "line_end")
    owned = relations.scoped(scan_files(f, "sql").where("raw not like '%SECTION%'"), fns).withColumn("sql_type", rules.sql_type(F.col("raw")))
    held = relations.scoped(c.where("kind = 'variable'").select("file_id", "line_start", "line_end", "name", F.regexp_replace("data_type", "^static ", "").alias("data_type")), fns).where("function is not null")
    contexts = context.function_contexts(fns, held, owned, c.where("kind = 'function_call'").select("file_id", F.col("parent").alias("function"), "name"))
    form = lambda name: context.prompt_text(contexts, name).withColumnRenamed("text", name)
    return form("compact").join(form("xml"), ["file_id", "function"])


_KEPT = ", ".join(f"'{k}'" for k in checks.KEPT)
_ALL_WORDS = ", ".join(f"'{k}'" for k in (*checks.KEYWORDS, "EXEC", "SQL"))
_N1 = r"trim(regexp_replace(regexp_replace(CASE WHEN sql_type = 'select' THEN regexp_replace(b, '(?is)\bINTO\s+:.*?\bFROM\b', 'FROM') WHEN sql_type = 'fetch_into' THEN regexp_replace(b, '(?is)\bINTO\s+.*$', '') ELSE b END, ';\s*$', ''), '\s+', ' ', 'g'))"
_CHECKED = TYPED + rf""", ba AS (SELECT *, regexp_replace(regexp_replace(sql_text, '(?i)^\s*EXEC\s+SQL\s+', ''), '(?i)^FOR\s+:?\w+\s+', '') AS b FROM ty),
 pr AS (SELECT file_id, sql_text AS s, regexp_replace(regexp_replace({_N1}, ':([A-Za-z_]\w*)\.(\w+)(?::\w+)?', '#{{\1_\2}}', 'g'), ':([A-Za-z_]\w*)(?:\[[^\]]+\])?(?::\w+)?', '#{{\1}}', 'g') AS p FROM ba),
 w AS (SELECT *, list_distinct(regexp_extract_all(upper(s), '\b([A-Z_]\w*)\b')) AS sw, list_distinct(regexp_extract_all(upper(p), '\b([A-Z_]\w*)\b')) AS pw,
  list_distinct(regexp_extract_all(upper(regexp_replace(s, '#\{{[^}}]*\}}|:\w+(?:\.\w+)?', ' ', 'g')), '\b([A-Z_]\w*)\b')) AS sn, list_distinct(regexp_extract_all(upper(regexp_replace(p, '#\{{[^}}]*\}}|:\w+(?:\.\w+)?', ' ', 'g')), '\b([A-Z_]\w*)\b')) AS pn FROM pr),
 x AS (SELECT *, len(list_filter(sw, lambda k: list_contains([{_KEPT}], k) AND NOT list_contains(pw, k))) AS lost, len(list_filter(sn, lambda k: NOT list_contains([{_ALL_WORDS}], k) AND NOT list_contains(pn, k))) AS names,
  len(list_distinct(regexp_extract_all(s, '{PLAIN}'))) AS nv, len(list_distinct(regexp_extract_all(p, '#\{{\w+'))) AS np FROM w),
 ch AS (SELECT file_id, unnest(['exec_sql_removed', 'host_vars_converted', 'semicolon_removed', 'keywords_kept', 'into_removed', 'identifiers_kept']) AS "check",
  unnest([CASE WHEN regexp_matches(p, '(?i)EXEC\s+SQL') THEN 'fail' ELSE 'pass' END, CASE WHEN regexp_matches(p, '{PLAIN}') THEN 'fail' WHEN nv > 0 AND np = 0 THEN 'warning' ELSE 'pass' END, CASE WHEN regexp_matches(p, ';\s*$') THEN 'warning' ELSE 'pass' END, CASE WHEN lost > 0 THEN 'warning' ELSE 'pass' END,
   CASE WHEN regexp_matches(s, '(?is)\bSELECT\b.*\bINTO\b') THEN CASE WHEN regexp_matches(p, '(?is)\bSELECT\b.*\bINTO\b') THEN 'fail' ELSE 'pass' END ELSE 'info' END, CASE WHEN names > 3 THEN 'warning' WHEN names > 0 THEN 'info' ELSE 'pass' END]) AS status FROM x)"""
ORACLES["k1_conversion_checks"] = _CHECKED + ' SELECT "check", status, CAST(count(*) AS BIGINT) AS n FROM ch GROUP BY ALL'
ORACLES["k2_check_totals"] = _CHECKED + " SELECT coalesce(CAST(file_id AS VARCHAR), 'all') AS file, count(CASE WHEN status = 'pass' THEN 1 END) AS n_pass, count(CASE WHEN status = 'fail' THEN 1 END) AS n_fail, count(CASE WHEN status = 'warning' THEN 1 END) AS n_warning FROM ch GROUP BY ROLLUP (file_id)"
ORACLES["k8_java_merge"] = f"SELECT CAST(o_custkey AS VARCHAR) AS class_id, 'package p;' || {NL} || {NL} || 'public class A {{' || {NL} || {NL} || string_agg('public int m' || o_orderkey % 3 || '() {{ return ' || o_orderkey || '; }}', {NL} || {NL} ORDER BY o_orderkey) || {NL} || '}}' || {NL} AS text FROM orders GROUP BY o_custkey"
ORACLES["s21_mapper_texts"] = TYPED + rf""", k AS (SELECT * FROM ty WHERE sql_type IN ('select', 'insert', 'update', 'delete')), i AS (SELECT *, sql_type || '_' || (row_number() OVER (PARTITION BY file_id, sql_type ORDER BY line_start) - 1) AS sql_name FROM k),
 m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(sql_text, '^EXEC SQL ', ''), 'SELECT o_totalprice, o_clerk_name INTO :h_price, :h_clerk FROM', 'SELECT o_totalprice AS hPrice, o_clerk_name AS hClerk FROM'), ':([A-Za-z_]\w*)\.(\w+)(?::\w+)?', '#{{\1_\2}}', 'g'), ':([A-Za-z_]\w*)(?:\[[^\]]+\])?(?::\w+)?', '#{{\1}}', 'g'), ';\s*$', '') AS q FROM i)
 SELECT file_id, '<!-- 2024-01-01 -->' || chr(13) || {NL} || '<mapper namespace="app">' || chr(13) || {NL} || string_agg('  <' || sql_type || ' id="' || sql_name || '">' || chr(13) || {NL} || '    ' || replace(replace(replace(q, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(13) || {NL} || '  </' || sql_type || '>', chr(13) || {NL} ORDER BY line_start) || chr(13) || {NL} || '</mapper>' || chr(13) || {NL} AS text FROM m GROUP BY file_id"""


@query("k7_report_lines", "SELECT 0 AS ord, '| file | pass | fail | warning |' AS value UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL SELECT CASE WHEN o_custkey IS NULL THEN 3 ELSE 2 END, '| ' || coalesce(CAST(o_custkey AS VARCHAR), 'all') || ' | ' || count(CASE WHEN o_orderstatus = 'F' THEN 1 END) || ' | ' || count(CASE WHEN o_orderstatus = 'O' THEN 1 END) || ' | ' || count(CASE WHEN o_orderstatus = 'P' THEN 1 END) || ' |' FROM orders GROUP BY ROLLUP (o_custkey)")
def k7(spark, sf_dir):
    told = rows_of(spark, sf_dir, "orders", "cast(o_custkey as string) AS file", "case o_orderstatus when 'F' then 'pass' when 'O' then 'fail' else 'warning' end AS status")
    return sinks.markdown_report(checks.check_totals(told))


@query("k9_merge_plugins", f"SELECT CAST(o_custkey AS VARCHAR) AS class_id, 'public class A {{' || {NL} || {NL} || string_agg('@Cat' || {NL} || 'public int m' || o_orderkey || '() {{ return ' || o_orderkey || '; }}', {NL} || {NL} ORDER BY o_orderkey) || {NL} || '}}' || {NL} AS text FROM orders GROUP BY o_custkey")
def k9(spark, sf_dir):
    """Visibility, then an annotation, on every method; registered in another order (U8)."""
    held = java.MergePlugins(java.with_annotation("@Cat"), java.single_main(), java.with_visibility("public"))
    given = "concat(element_at(array('private ', '', '@Cat\npublic '), cast(o_orderkey % 3 + 1 as int)), 'int m', o_orderkey, '() { return ', o_orderkey, '; }')"
    return java.merge_with(rows_of(spark, sf_dir, "orders", "cast(o_custkey as string) AS class_id", "'public class A {\n}\n' AS skeleton", f"{given} AS llm_response", "o_orderkey AS ord"), held)


@query("k4_structs_and_classes", "SELECT p_partkey AS file_id, CAST(p_partkey % 3 + 1 AS BIGINT) AS in_text, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS extracted, p_partkey % 5 = 0 AS has_class FROM part")
def k4(spark, sf_dir):
    t = rows_of(spark, sf_dir, "part", "p_partkey AS file_id", "repeat('struct s { int a; };\n', cast(p_partkey % 3 + 1 as int)) AS content", "concat('public class ', if(p_partkey % 5 = 0, 'Part', 'Parts'), p_partkey, ' {}') AS text")
    counted = builds.struct_checks(t, t.where("file_id % 2 = 0"))
    return counted.join(builds.class_checks(t.select("file_id", "text"), F.concat(F.lit("Part"), "file_id")).select("file_id", "has_class"), "file_id")


@query("a19_merged_graphs", "SELECT 'n' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS edges FROM customer")
def a19(spark, sf_dir):
    c = lambda name: rows_of(spark, sf_dir, "customer", "concat('n', c_custkey) AS id", f"{name} AS name", "c_custkey AS k")
    edges = lambda df: df.select(F.col("id").alias("source_id"), F.lit("x").alias("target_id"))
    one, two = c("c_name"), c("c_mktsegment").where("k % 3 = 0")
    nodes, links = graphs.merged((one, edges(one)), (two, edges(two)))
    return nodes.join(links.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("edges")), "id").select("id", "name", "edges")


@query("a21_note_stats", "SELECT 'tag:' || unnest([o_orderstatus, o_orderpriority]) AS name, CAST(count(*) AS BIGINT) AS n, -1.0::DOUBLE AS success_rate, -1.0::DOUBLE AS avg_steps FROM orders GROUP BY 1 UNION ALL SELECT 'episodes:' || o_orderstatus, count(*), round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 9), round(avg(o_orderkey % 11), 9) FROM orders GROUP BY o_orderstatus")
def a21(spark, sf_dir):
    notes = rows_of(spark, sf_dir, "orders", "array(o_orderstatus, o_orderpriority) AS tags")
    episodes = rows_of(spark, sf_dir, "orders", "o_orderstatus AS task", "o_orderkey % 3 = 0 AS success", "o_orderkey % 11 AS steps", "1.0D AS score")
    tags = context.tag_counts(notes).select(F.concat(F.lit("tag:"), "tag").alias("name"), "n", F.lit(-1.0).alias("success_rate"), F.lit(-1.0).alias("avg_steps"))
    return tags.unionByName(context.episode_stats(episodes, "task").select(F.concat(F.lit("episodes:"), "task").alias("name"), "n", F.round("success_rate", 9).alias("success_rate"), F.round("avg_steps", 9).alias("avg_steps")))


@query("w1_elements_in_order", "SELECT o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 NULLS LAST, o_orderkey) AS INTEGER) AS position FROM orders")
def w1(spark, sf_dir):
    return context.in_order(rows_of(spark, sf_dir, "orders", "o_custkey AS file_id", "o_orderkey % 5 AS line_start", "o_orderkey AS seq", "o_orderkey AS k")).select("k", "position")


_IMPORT = "CASE o_orderkey % 3 WHEN 0 THEN 'java.util.X' WHEN 1 THEN 'javax.sql.Y' ELSE 'com.app.Z' END || o_orderkey % 17"


@query("w5_sorted_imports", f"SELECT o_custkey AS class_id, string_agg(i, ',' ORDER BY CASE WHEN starts_with(i, 'java.') THEN 0 WHEN starts_with(i, 'javax.') THEN 1 ELSE 2 END, i) AS imports FROM (SELECT DISTINCT o_custkey, {_IMPORT} AS i FROM orders) GROUP BY o_custkey")
def w5(spark, sf_dir):
    t = rows_of(spark, sf_dir, "orders", "o_custkey AS class_id", f"{_IMPORT} AS name").distinct()
    ordered = F.array_sort(F.collect_list(context.import_order(F.col("name"))))
    return t.groupBy("class_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ",").alias("imports"))


@query("w6_docstrings", f"SELECT o_orderkey AS line, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE '/* one ' || o_orderkey || ' */' || {NL} || '// two' END AS docstring FROM orders")
def w6(spark, sf_dir):
    """Comments right above a function, chained; those of every third function are too far."""
    fns = rows_of(spark, sf_dir, "orders", "o_custkey AS file_id", "concat('f', o_orderkey) AS name", "o_orderkey * 100 + 50 AS line_start", "o_orderkey AS line")
    notes = rows_of(spark, sf_dir, "orders", "o_custkey AS file_id", "inline(array(struct(o_orderkey * 100 + 44 - if(o_orderkey % 3 = 2, 9, 0) AS line_start, o_orderkey * 100 + 46 - if(o_orderkey % 3 = 2, 9, 0) AS line_end, concat('/* one ', o_orderkey, ' */') AS raw), struct(o_orderkey * 100 + 48 - if(o_orderkey % 3 = 2, 9, 0) AS line_start, o_orderkey * 100 + 48 - if(o_orderkey % 3 = 2, 9, 0) AS line_end, '// two' AS raw)))")
    return relations.docstrings(fns, notes).select("line", F.coalesce("docstring", F.lit("")).alias("docstring"))


@query("x2_identifiers_lost", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 > 3 THEN 'warning' WHEN o_orderkey % 6 > 0 THEN 'info' ELSE 'pass' END AS status FROM orders")
def x2(spark, sf_dir):
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS file", "concat('SELECT a', concat_ws('', transform(sequence(0, cast(o_orderkey % 6 as int)), i -> concat(', c', i))), ' FROM t') AS sql", "'SELECT a, c0 FROM t' AS parsed_sql")
    return checks.conversion_checks(t).where("check = 'identifiers_kept'").select(F.col("file").alias("k"), "status")


@query("c17_trees", "WITH f AS (SELECT DISTINCT 'd' || s_nationkey AS d FROM supplier), r AS (SELECT d, row_number() OVER (ORDER BY d) AS k, row_number() OVER (ORDER BY d DESC) = 1 AS last FROM f), p AS (SELECT 'd' || s_nationkey AS d, 's' || s_suppkey || '.pc' AS n, s_suppkey AS len FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC) = 1 AS end_ FROM p) SELECT d AS path, CASE WHEN last THEN '└── ' ELSE '├── ' END || d || '/' AS line FROM r UNION ALL SELECT o.d || '/' || n, CASE WHEN r.last THEN '    ' ELSE '│   ' END || CASE WHEN end_ THEN '└── ' ELSE '├── ' END || n || ' (' || len || ' bytes)' FROM o JOIN r USING (d)")
def c17(spark, sf_dir):
    listed = rows_of(spark, sf_dir, "supplier", "concat('d', s_nationkey, '/s', s_suppkey, '.pc') AS path", "s_suppkey AS length").unionByName(rows_of(spark, sf_dir, "supplier", "concat('d', s_nationkey, '/x.txt') AS path", "s_suppkey AS length"))
    return files.tree(files.globbed(listed, "d*/*.pc")).select("path", "line")


@query("u6_rewrite_steps", f"SELECT o_orderkey AS k, concat('SELECT IFNULL(a, ', o_orderkey, ') FROM t', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' LIMIT 5' END) AS sql, CASE WHEN o_orderkey % 2 = 0 THEN 'names,dialect' ELSE 'dialect' END AS applied FROM orders")
def u6(spark, sf_dir):
    """Steps by priority, one switched off, one that applies to some texts only."""
    steps = rw.Pipeline(rw.Step("dialect", 70, rw.oracle_to_mysql), rw.Step("off", 1, F.upper, enabled=False), rw.Step("names", 5, lambda c: F.regexp_replace(c, " LIMIT 5$", ""), lambda c: F.regexp_like(c, F.lit("even"))), rw.Step("same", 80, F.trim))
    t = rows_of(spark, sf_dir, "orders", "o_orderkey AS k", "concat('SELECT NVL(a, ', o_orderkey, ')', if(o_orderkey % 2 = 0, ' /* even */', ''), ' FROM t LIMIT 5') AS t")
    out = t.select("k", steps.run(F.col("t")).alias("r"))
    return out.select("k", F.replace("r.sql", F.lit(" /* even */"), F.lit("")).alias("sql"), F.array_join("r.applied", ",").alias("applied"))
