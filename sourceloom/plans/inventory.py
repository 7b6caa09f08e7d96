"""Registered queries of scopes, sections, aliases, graph builds, verification and text outputs, with checking SQL.

The derived files and headers vary by line and name, so that expected rows are
computed, not constant.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hostvars as hv
from ..functions import rewrite as rw
from ..functions import rules
from ..functions import text as shown
from ..functions.corpus import FILES, HEADERS, check_derived, derived, statements
from ..operators import builds, graphs, relations
from ..operators.scanner import scan_files
from ..sources import sinks
from ..storage import spread, stored
from .queries import _CUR, ORACLES, PLAIN, ST, TYPED, query, read, typed

FI = check_derived("fi", FILES, "customer")
HE = check_derived("he", HEADERS, "supplier")
NL = "chr(10)"


def files(spark, sf_dir):
    return derived(spark, sf_dir, FILES, "customer")


def headers(spark, sf_dir):
    return derived(spark, sf_dir, HEADERS, "supplier")


@query("b4_plain_blocks", "SELECT c_custkey AS file_id, CAST(c_custkey % 5 + l + CASE WHEN l = 10 THEN c_custkey % 3 ELSE 0 END AS BIGINT) AS line_start, raw FROM customer, (VALUES (2, 'BEGIN DECLARE SECTION'), (5, 'END DECLARE SECTION'), (10, 'SELECT a FROM t WHERE x = :h_name')) v(l, raw)")
def b4(spark, sf_dir):
    return scan_files(files(spark, sf_dir), "plain_sql").select("file_id", "line_start", "raw")


@query("b5_declare_sections", f"SELECT c_custkey AS file_id, CAST(c_custkey % 5 + 2 AS BIGINT) AS line_start, CAST(c_custkey % 5 + 5 AS BIGINT) AS line_end, 'char h_name[20];' || {NL} || 'int h_' || c_custkey || ';' AS raw FROM customer")
def b5(spark, sf_dir):
    return scan_files(files(spark, sf_dir), "section").select("file_id", "line_start", "line_end", "raw")


@query("c9_variable_scopes", "SELECT c_custkey AS file_id, CAST(c_custkey % 5 + l AS BIGINT) AS line_start, replace(name, '#', CAST(c_custkey AS VARCHAR)) AS name, scope FROM customer, (VALUES (1, 'g_count', 'global'), (3, 'h_name', 'declare_section'), (4, 'h_#', 'declare_section'), (6, 's_total', 'static'), (8, 'loc', 'local'), (9, 'hits', 'static_local')) v(l, name, scope)")
def c9(spark, sf_dir):
    f = files(spark, sf_dir)
    c = stored(scan_files(f, "c"))  # read more than once
    scoped = relations.declared_scope(c.where("kind = 'variable'").select("file_id", "line_start", "name", "raw"), scan_files(f, "section"), c.where("kind = 'function'"))
    return scoped.select("file_id", "line_start", "name", "scope")


@query("j4_variables_in_sections", "SELECT c_custkey AS file_id, replace(name, '#', CAST(c_custkey AS VARCHAR)) AS name FROM customer, (VALUES ('h_name'), ('h_#')) v(name)")
def j4(spark, sf_dir):
    f = files(spark, sf_dir)
    variables = scan_files(f, "c", fields=("name", "line_start"), kinds=("variable",))
    return relations.inside_spans(variables, scan_files(f, "section", fields=("line_start", "line_end"))).select("file_id", "name")


@query("s14_section_files", f"SELECT c_custkey AS file_id, 'declare_section_0.c' AS name, 'char h_name[20];' || {NL} || 'int h_' || c_custkey || ';' AS body FROM customer")
def s14(spark, sf_dir):
    return sinks.section_files(scan_files(files(spark, sf_dir), "section"))


_BASE = r"regexp_replace(regexp_replace(sql_text, '^EXEC SQL (FOR :batch_size )?', ''), ';$', '')"


@query("n2_token_normalize", TYPED + rf" SELECT line_start, regexp_replace(CASE sql_type WHEN 'fetch_into' THEN regexp_replace({_BASE}, ' INTO .*$', '') WHEN 'select' THEN regexp_replace({_BASE}, 'INTO .*? FROM', 'FROM') ELSE {_BASE} END, '{PLAIN}', '?', 'g') AS sql FROM ty")
def n2(spark, sf_dir):
    st = statements(spark, sf_dir)
    return scan_files(st, "tokens", "line_start", "sql_text").select("line_start", "sql")


_VN = rf"len(regexp_extract_all(sql_text, '{PLAIN}')) + len(regexp_extract_all(sql_text, ':\w+(?:\.\w+)?:\w+'))"
_VO = rf"CASE WHEN sql_type = 'fetch_into' THEN 3 WHEN sql_type = 'select' AND sql_text LIKE '%INTO%' THEN 2 ELSE 0 END"


@query("v6_token_variables", TYPED + f" SELECT line_start, CAST({_VN} - ({_VO}) AS BIGINT) AS n_in, CAST({_VO} AS BIGINT) AS n_out FROM ty")
def v6(spark, sf_dir):
    found = scan_files(statements(spark, sf_dir), "tokens", "line_start", "sql_text")
    return found.select("line_start", F.size("inputs").cast("long").alias("n_in"), F.size("outputs").cast("long").alias("n_out"))


@query("n8_aliases_in_place", f"SELECT o_orderkey AS k, 'EXEC SQL SELECT a AS xOne, f(b, c) AS y' || o_orderkey % 10 || ', a1 AS zZ, d AS z INTO :x_one, :y_' || o_orderkey % 10 || ', :z_z' || {NL} || 'FROM tab WHERE a = ' || o_orderkey || ' AND a1 = :lim;' AS sql FROM orders")
def n8(spark, sf_dir):
    text = F.expr("concat('EXEC SQL SELECT a, f(b, c),\n a1, d AS z INTO :x_one, :y_', o_orderkey % 10, ', :z_z\nFROM tab WHERE a = ', o_orderkey, ' AND a1 = :lim;')")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("t"))
    return rows.select("k", rw.with_aliases(F.col("t"), hv.outputs(F.col("t"), F.lit("select"))).alias("sql"))


_N3 = r"replace(regexp_replace(sql_text, '^EXEC SQL ', ''), 'SELECT o_totalprice, o_clerk_name INTO :h_price, :h_clerk FROM', 'SELECT o_totalprice AS hPrice, o_clerk_name AS hClerk FROM')"


ORACLES["n3_mapper_sql"] = TYPED + rf" SELECT line_start, regexp_replace(regexp_replace(regexp_replace({_N3}, ':([A-Za-z_]\w*)\.(\w+)(?::\w+)?', '#{{\1_\2}}', 'g'), ':([A-Za-z_]\w*)(?:\[[^\]]+\])?(?::\w+)?', '#{{\1}}', 'g'), ';\s*$', '') AS sql FROM ty WHERE sql_type IN ('select', 'insert', 'update', 'delete')"


@query("n6_default_formatters", "SELECT DISTINCT o_orderkey % 97 AS k, '#{hKey' || o_orderkey % 97 || '}' AS input, 'hKey' || o_orderkey % 97 AS output FROM orders")
def n6(spark, sf_dir):
    v = F.expr("concat(':h_key_', o_orderkey % 97)")
    return read(spark, sf_dir, "orders").select(F.expr("o_orderkey % 97").alias("k"), rw.default_input(v).alias("input"), rw.default_output(v).alias("output")).distinct()


@query("h3_every_decode", f"SELECT o_orderkey AS k, 'SELECT CASE k WHEN ' || o_orderkey || ' THEN a ELSE b END, CASE s WHEN 1 THEN x WHEN 2 THEN y END' || {NL} || 'FROM t WHERE CONCAT(p, q) = r AND DATE_ADD(d, INTERVAL ' || o_orderkey % 12 || ' MONTH) > TIMESTAMPDIFF(MONTH, v, u)' AS sql FROM orders")
def h3(spark, sf_dir):
    text = F.expr("concat('SELECT DECODE(k, ', o_orderkey, ', a, b), DECODE(s, 1, x, 2, y)\nFROM t WHERE p\n  || q = r AND ADD_MONTHS(d, ', o_orderkey % 12, ') > MONTHS_BETWEEN(u, v)')")
    return spread(read(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("k"), rw.oracle_to_mysql(text).alias("sql"))


@query("h7_paging_gate", TYPED + " SELECT line_start, (sql_type = 'declare_cursor' OR (sql_type = 'select' AND line_start % 3 = 0)) AS paged FROM ty")
def h7(spark, sf_dir):
    kind = F.col("sql_type")
    return typed(spark, sf_dir).select("line_start", rw.needs_paging(kind, kind == "declare_cursor", F.col("line_start") % 3 == 0).alias("paged"))


@query("h10_first_rows", ST + r" SELECT line_start, CASE WHEN sql_text LIKE '%FETCH FIRST%' THEN sql_text ELSE regexp_replace(sql_text, ';$', '') || ' FETCH FIRST #{limit} ROWS ONLY' END AS sql FROM st WHERE sql_text LIKE '%SELECT%'")
def h10(spark, sf_dir):
    return statements(spark, sf_dir).where("sql_text like '%SELECT%'").select("line_start", rw.first_rows(F.col("sql_text")).alias("sql"))


_H1 = "replace(replace(replace(replace(replace(sql_text, 'NVL(', 'IFNULL('), 'SYSDATE', 'NOW()'), 'SUBSTR(', 'SUBSTRING('), 'DECODE(k, 1, :x1, :x2)', 'CASE k WHEN 1 THEN :x1 ELSE :x2 END'), 'first_nm || last_nm', 'CONCAT(first_nm, last_nm)')"


ORACLES["h1_pipeline_applied"] = ST + f", d AS (SELECT line_start, sql_text, {_H1} AS x, sql_text LIKE '%SELECT%' AND sql_text NOT LIKE '%FETCH FIRST%' AS p FROM st) SELECT line_start, CASE WHEN p THEN x || ' LIMIT #{{limit}} OFFSET #{{offset}}' ELSE x END AS sql, concat_ws(',', CASE WHEN x <> sql_text THEN 'dialect' END, CASE WHEN p THEN 'paging' END) AS applied FROM d"


@query("c3_known_kinds", TYPED + " SELECT line_start, sql_type FROM ty WHERE sql_type <> 'unknown'")
def c3(spark, sf_dir):
    return statements(spark, sf_dir).select("line_start", rules.strict_type(F.col("sql_text")).alias("sql_type")).where("sql_type is not null")


@query("c5_substring_kinds", ST + " SELECT line_start, CASE WHEN upper(sql_text) LIKE 'EXEC SQL SELECT%' THEN 'select' WHEN sql_text LIKE '%CURSOR%' THEN 'declare_cursor' WHEN sql_text LIKE 'EXEC SQL INSERT%' THEN 'insert' WHEN sql_text LIKE 'EXEC SQL UPDATE%' THEN 'update' WHEN sql_text LIKE 'EXEC SQL DELETE%' THEN 'delete' WHEN sql_text LIKE 'EXEC SQL FETCH%' THEN 'fetch_into' ELSE 'unknown' END AS kind FROM st")
def c5(spark, sf_dir):
    return statements(spark, sf_dir).select("line_start", rules.kind_by_substring(F.col("sql_text")).alias("kind"))


@query("c8_headers_by_type", HE + " SELECT 'macro' AS header_type, CAST(count(*) AS BIGINT) AS n, string_agg(file_id, ',' ORDER BY file_id) AS files FROM he")
def c8(spark, sf_dir):
    return rules.typed_headers(headers(spark, sf_dir)).select("header_type", "n", F.array_join("files", ",").alias("files"))


@query("c10_predicates", "SELECT DISTINCT o_orderkey % 4 AS k, o_orderkey % 4 < 2 AS is_primitive, o_orderkey % 4 >= 2 AS is_struct, o_orderkey % 4 IN (1, 3) AS is_ddl FROM orders")
def c10(spark, sf_dir):
    kind = F.expr("element_at(array('int', ' Char', 'order_t', 'struct_x'), cast(o_orderkey % 4 as int) + 1)")
    change = F.expr("element_at(array('select', 'CREATE', 'update', 'drop'), cast(o_orderkey % 4 as int) + 1)")
    return read(spark, sf_dir, "orders").select(F.expr("o_orderkey % 4").alias("k"), rules.is_primitive(kind).alias("is_primitive"), rules.is_custom_struct(kind).alias("is_struct"), rules.is_ddl(change).alias("is_ddl")).distinct()


@query("c18_blacklist", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ':json' WHEN 2 THEN ':h_' || o_orderkey ELSE ':special' END AS variables FROM orders")
def c18(spark, sf_dir):
    words = hv.blacklist(hv.TIME_FORMATS, hv.DB2_REGISTERS, hv.POSTGRESQL_TYPES, hv.SINGLE_LETTERS, add=("mine",), remove=("JSON",))
    text = F.expr("concat('x = ', element_at(array(':Hh24 :timezone :uuid :mine', ':json', concat(':h_', o_orderkey), ':n :special'), cast(o_orderkey % 4 as int) + 1))")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(hv.variables(text, words), ",").alias("variables"))


@query("x3_blacklist_union", "SELECT DISTINCT upper(w) AS word FROM (SELECT unnest(['" + "', '".join(hv.TIME_FORMATS + hv.DB2_REGISTERS) + "']) AS w UNION ALL SELECT lower(r_name) FROM region)")
def x3(spark, sf_dir):
    return hv.word_union(spark, [hv.TIME_FORMATS, hv.DB2_REGISTERS], add=read(spark, sf_dir, "region").select(F.col("r_name").alias("word")))


@query("a4_cursor_reads", TYPED + _CUR + " SELECT d.name, d.line_start AS declare_line, count(CASE WHEN c.sql_type = 'fetch_into' THEN 1 END) > 1 AS is_loop, count(CASE WHEN c.sql_type = 'fetch_into' THEN 1 END) > 0 AS reads_rows, 'cursor_' || d.name || '_' || lpad(CAST(row_number() OVER (PARTITION BY d.file_id, d.name ORDER BY d.line_start) AS VARCHAR), 3, '0') AS relationship_id FROM d LEFT JOIN c ON c.file_id = d.file_id AND c.name = d.name AND c.line_start > d.line_start AND (d.nxt IS NULL OR c.line_start < d.nxt) GROUP BY d.file_id, d.name, d.line_start")
def a4(spark, sf_dir):
    return relations.cursor_groups(typed(spark, sf_dir)).select("name", "declare_line", "is_loop", "reads_rows", "relationship_id")


@query("a3_merged_cursor_sql", TYPED + " SELECT line_start, 'SELECT a_id, b_name ' || CASE WHEN EXISTS (SELECT 1 FROM ty f WHERE f.file_id = ty.file_id AND f.sql_type = 'fetch_into') THEN 'INTO :h_a, :h_b ' ELSE '' END || 'FROM t WHERE b = :h_b' AS sql FROM ty WHERE sql_type = 'declare_cursor'")
def a3(spark, sf_dir):
    text, ty = F.col("sql_text"), typed(spark, sf_dir)
    fetched = ty.where("sql_type = 'fetch_into'").select("file_id", F.regexp_extract(text, r"FETCH\s+(\w+)", 1).alias("name"), "line_start", F.transform(hv.outputs(text, F.lit("fetch_into")), lambda v: F.concat(F.lit(":"), hv.name_of(v))).alias("vars"))
    declared = ty.where("sql_type = 'declare_cursor'").withColumn("name", F.regexp_extract(text, r"DECLARE\s+(\w+)", 1))
    return declared.join(relations.merged_cursor(fetched), ["file_id", "name"], "left").select("line_start", relations.merged_cursor_sql(text, F.col("into_clause")).alias("sql"))


@query("a8_array_ids", ST + " SELECT line_start, 'array_' || function || '_' || lpad(CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_start) AS VARCHAR), 3, '0') AS relationship_id FROM st WHERE sql_text LIKE '%FOR :batch_size%'")
def a8(spark, sf_dir):
    return relations.array_dml(statements(spark, sf_dir)).select("line_start", "relationship_id")


@query("a9_rollback_after", TYPED + """, b AS (SELECT * FROM ty WHERE sql_type IN ('commit', 'rollback')), s AS (SELECT file_id, function, (SELECT min(x.line_start) FROM b x WHERE x.file_id = t.file_id AND x.function = t.function AND x.line_start > t.line_start) AS bl FROM ty t WHERE sql_type NOT IN ('commit', 'rollback', 'connect'))
 SELECT DISTINCT bl AS boundary_line, EXISTS (SELECT 1 FROM b x WHERE x.file_id = s.file_id AND x.function = s.function AND x.sql_type = 'rollback' AND x.line_start > s.bl) AS has_rollback FROM s WHERE bl IS NOT NULL""")
def a9(spark, sf_dir):
    return relations.transactions(typed(spark, sf_dir)).select("boundary_line", "has_rollback")


_FREED = "CASE WHEN sql_text LIKE '%INCLUDE%' THEN concat('EXEC SQL DEALLOCATE PREPARE s', file_id, '_;') ELSE sql_text END"


@query("j7_deallocated", TYPED + f""", c AS (SELECT file_id, line_start, CASE WHEN sql_text LIKE '%INCLUDE%' THEN 'free' ELSE sql_type END AS k FROM ty WHERE sql_type = 'prepare' OR sql_text LIKE '%INCLUDE%'), d AS (SELECT *, lead(line_start) OVER (PARTITION BY file_id ORDER BY line_start) AS nxt FROM c WHERE k = 'prepare')
 SELECT d.line_start AS prepare_line, coalesce(min(c.line_start), -1) AS deallocate_line FROM d LEFT JOIN c ON c.file_id = d.file_id AND c.k = 'free' AND c.line_start > d.line_start AND (d.nxt IS NULL OR c.line_start < d.nxt) GROUP BY d.line_start""")
def j7(spark, sf_dir):
    st = typed(spark, sf_dir).withColumn("sql_text", F.expr(_FREED))
    return relations.dynamic_groups(st).select("prepare_line", F.coalesce("deallocate_line", F.lit(-1)).alias("deallocate_line"))


@query("g6_dependency_edges", "SELECT 'h' || s_suppkey || '.h' AS source_id, 'h' || CAST(floor(s_suppkey / 3) AS INT) || '.h' AS target_id, 'local' AS kind FROM supplier UNION ALL SELECT 'h' || s_suppkey || '.h', 'stdio.h', 'system' FROM supplier")
def g6(spark, sf_dir):
    return builds.dependency_graph(headers(spark, sf_dir))[1]


@query("g6_dependency_nodes", "SELECT 'h' || s_suppkey || '.h' AS id, 'file' AS kind FROM supplier UNION ALL SELECT 'stdio.h', 'system'")
def g6_nodes(spark, sf_dir):
    return builds.dependency_graph(headers(spark, sf_dir))[0]


@query("g8_header_pipeline", """WITH RECURSIVE w(k, depth) AS (SELECT max(s_suppkey), 0 FROM supplier UNION ALL SELECT CAST(floor(k / 3) AS INT), depth + 1 FROM w WHERE k > 0)
 SELECT 'h' || k || '.h' AS file_id, depth, 'macro' AS header_type, CAST(1 AS BIGINT) AS macros FROM w""")
def g8(spark, sf_dir):
    roots = read(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("k")).select(F.expr("concat('h', k, '.h')").alias("node"))
    return builds.header_pipeline(headers(spark, sf_dir), roots)


@query("g7_lineage_nodes", "SELECT 'n' || c_custkey AS id, 'function' AS kind, c_name AS name FROM customer UNION ALL SELECT 'n' || s_suppkey, 'struct', s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def g7(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    return builds.lineage_nodes(("function", c.select(F.expr("concat('n', c_custkey)").alias("id"), F.col("c_name").alias("name"))), ("struct", s.select(F.expr("concat('n', s_suppkey)").alias("id"), F.col("s_name").alias("name"))))


@query("j17_known_calls", "SELECT DISTINCT 'f' || p_partkey % 50 AS source_id, 'f' || p_size AS target_id FROM part WHERE p_size < 50")
def j17(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return builds.call_links(p.selectExpr("concat('f', p_partkey % 50) as parent", "concat('f', p_size) as name"), spark.range(50).selectExpr("concat('f', id) as name"))


@query("j19_include_links", "SELECT 'h' || s_suppkey || '.h' AS source_id, 'stdio.h' AS target_id, 'INCLUDES' AS link FROM supplier UNION ALL SELECT 'prog' || s_nationkey, 'h' || s_suppkey || '.h', 'CONTAINS' FROM supplier")
def j19(spark, sf_dir):
    edges = builds.dependency_graph(headers(spark, sf_dir))[1].where("kind = 'system'")
    return builds.include_links(edges, read(spark, sf_dir, "supplier").selectExpr("concat('prog', s_nationkey) as program", "concat('h', s_suppkey, '.h') as file_id"))


@query("j23_macro_uses", "SELECT 'LIMIT_' || s_suppkey AS macro, 's_total' AS variable FROM supplier")
def j23(spark, sf_dir):
    return builds.macro_uses(scan_files(headers(spark, sf_dir), "directive").where("kind = 'macro'"), scan_files(files(spark, sf_dir), "c", fields=("name",), kinds=("variable",)))


@query("j28_promoted_issues", "SELECT c_mktsegment || ' ' || c_nationkey AS text, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 HAVING count(*) >= 3")
def j28(spark, sf_dir):
    return builds.promoted_issues(read(spark, sf_dir, "customer").select(F.expr("concat(c_mktsegment, ' ', c_nationkey)").alias("text")))


_ISSUE = "concat('case', CAST(floor(o_orderkey / 2) AS INT), ' area', CAST(floor(o_orderkey / 3) AS INT), ' Owner', o_orderkey % 997)"


@query("j28_overlapping_issues", f"""WITH u AS (SELECT o_orderkey AS id, unnest(list_distinct(string_split(lower({_ISSUE}), ' '))) AS x FROM orders), s AS (SELECT id, count(*) AS n FROM u GROUP BY id)
 SELECT a.id AS a, b.id AS b, round(count(*) / least(any_value(sa.n), any_value(sb.n)), 6) AS overlap FROM u a JOIN u b ON a.x = b.x AND a.id < b.id JOIN s sa ON sa.id = a.id JOIN s sb ON sb.id = b.id GROUP BY a.id, b.id HAVING count(*) / least(any_value(sa.n), any_value(sb.n)) > 0.5""")
def j28_pairs(spark, sf_dir):
    issues = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_ISSUE).alias("text"))
    return graphs.similar_issues(issues).withColumn("overlap", F.round("overlap", 6))


@query("k4_element_checks", ST + " SELECT file_id, 'line_ranges' AS check, CAST(count(CASE WHEN line_start % 7 = 0 THEN 1 END) AS BIGINT) AS failed FROM st GROUP BY file_id UNION ALL SELECT file_id, 'required_fields', CAST(count(CASE WHEN line_start % 11 = 0 THEN 1 END) AS BIGINT) FROM st GROUP BY file_id")
def k4(spark, sf_dir):
    st = statements(spark, sf_dir).withColumns({"line_end": F.expr("line_start + line_start % 7 - 1"), "sql_id": F.expr("if(line_start % 11 = 0, null, 'x')")})
    return builds.element_checks(st)


@query("k5_verifier_stages", TYPED + """ SELECT phase, ordinal, "check", CASE "check" WHEN 'has_prefix' THEN 'PASS' WHEN 'known_kind' THEN CASE WHEN sql_type = 'unknown' THEN 'FAIL' ELSE 'PASS' END WHEN 'model' THEN 'SKIPPED' ELSE CASE WHEN sql_text LIKE '%;' THEN 'PASS' ELSE 'WARN' END END AS status, CAST(count(*) AS BIGINT) AS n
 FROM ty, (VALUES ('pre', 0, 'has_prefix'), ('verify', 1, 'known_kind'), ('verify', 2, 'model'), ('post', 3, 'closed')) v(phase, ordinal, "check") GROUP BY ALL""")
def k5(spark, sf_dir):
    ok = lambda c, no: F.when(c, "PASS").otherwise(no)
    checks = builds.Verifier(
        builds.Stage("closed", "post", lambda d: ok(F.endswith("sql_text", F.lit(";")), "WARN")),
        builds.Stage("model", "verify", None, 60),
        builds.Stage("known_kind", "verify", lambda d: ok(F.col("sql_type") != "unknown", "FAIL"), 10),
        builds.Stage("has_prefix", "pre", lambda d: ok(F.startswith("sql_text", F.lit("EXEC SQL")), "FAIL")),
    )
    return checks.run(typed(spark, sf_dir)).groupBy("phase", "ordinal", "check", "status").agg(F.count(F.lit(1)).alias("n"))


@query("s13_sql_calls", TYPED + f", i AS (SELECT *, 'sql_' || lpad(CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_start) AS VARCHAR), 3, '0') AS sql_id FROM ty) SELECT file_id, 'sql_calls:' || {NL} || string_agg('- sql_id: ' || sql_id || {NL} || '  sql_type: ' || sql_type || {NL} || '  sql: |' || {NL} || '    ' || sql_text || {NL}, '' ORDER BY line_start) AS yaml FROM i GROUP BY file_id")
def s13(spark, sf_dir):
    return sinks.sql_calls_yaml(relations.statement_ids(typed(spark, sf_dir)))


@query("w7_limits", ST + f" SELECT line_start, substr(sql_text, 1, 40) AS shown, CAST(least(2, len(regexp_extract_all(sql_text, '{PLAIN}'))) AS BIGINT) AS n_shown FROM st")
def w7(spark, sf_dir):
    text = F.col("sql_text")
    return statements(spark, sf_dir).select("line_start", shown.shortened(text, 40, "").alias("shown"), F.size(shown.first_of(hv.variables(text), 2)).cast("long").alias("n_shown"))
