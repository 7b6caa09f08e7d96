"""Registered queries of the source-analysis operators on the derived corpus, with checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hostvars as hv
from ..functions import rewrite as rw
from ..functions import rules, text
from ..functions.corpus import check_statements, statements
from ..operators import checks, context, graphs, java, relations
from ..operators.scanner import scan_files
from ..sources import sinks
from ..storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ST = check_statements()
TYPED = ST + ", ty AS (SELECT *, " + rules.RuleSet().check_case("sql_text") + " AS sql_type FROM st)"
PLAIN = hv.PLAIN_VARIABLE
_INTO = r"'(?is)\bINTO\b(.*?)(?:\bFROM\b|\bWHERE\b|;|$)'"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).withColumn("sql_type", rules.sql_type(F.col("sql_text")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n():
    return F.count(F.lit(1)).cast("long").alias("n")


@query("c1_sql_type_counts", TYPED + " SELECT sql_type, CAST(count(*) AS BIGINT) AS n FROM ty GROUP BY sql_type")
def c1(spark, sf_dir):
    return typed(spark, sf_dir).groupBy("sql_type").agg(n())


@query("c2_dialect_rules", ST + " SELECT " + rules.RuleSet(rules.TYPE_RULES + rules.DB2_RULES).check_case("sql_text") + r""" AS rule,
 upper(regexp_extract(sql_text, '(?i)WITH\s+(UR|CS|RS|RR)', 1)) AS isolation_level, regexp_extract(sql_text, '(?i)FETCH\s+FIRST\s+(\d+)', 1) AS fetch_first, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY ALL""")
def c2(spark, sf_dir):
    st = statements(spark, sf_dir)
    meta = rules.db2_metadata(F.col("sql_text"))
    ruled = st.select(rules.RuleSet().register(*rules.DB2_RULES).compile(F.col("sql_text")).alias("rule"), meta.alias("m"))
    none = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(k)
    return ruled.select("rule", none("isolation_level"), none("fetch_first")).groupBy("rule", "isolation_level", "fetch_first").agg(n())


@query("c4_first_word", ST + r" SELECT upper(regexp_extract(regexp_replace(regexp_replace(sql_text, 'EXEC\s+SQL', ' '), 'FOR\s+:\w+\s+', ' '), '^\s*(\w+)', 1)) AS word, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY 1")
def c4(spark, sf_dir):
    return statements(spark, sf_dir).groupBy(rules.first_word_type(F.col("sql_text")).alias("word")).agg(n())


@query("c6_display_and_tags", TYPED + """ SELECT sql_type, CASE sql_type WHEN 'fetch_into' THEN 'FETCH' WHEN 'declare_cursor' THEN 'DECLARE' WHEN 'open_cursor' THEN 'OPEN' WHEN 'close_cursor' THEN 'CLOSE' ELSE upper(sql_type) END AS shown,
 CASE WHEN sql_type IN ('insert', 'update', 'delete') THEN sql_type ELSE 'select' END AS tag, CASE WHEN sql_type IN ('select', 'insert', 'delete') THEN sql_type ELSE 'update' END AS other_tag, CAST(count(*) AS BIGINT) AS n FROM ty GROUP BY ALL""")
def c6(spark, sf_dir):
    kind = F.col("sql_type")
    return typed(spark, sf_dir).select(kind, rules.display_type(kind).alias("shown"), rules.tag(kind).alias("tag"), rules.tag(kind, rules.GENERATOR_TAGS).alias("other_tag")).groupBy("sql_type", "shown", "tag", "other_tag").agg(n())


@query("c11_keyword_counts", ST + r", w AS (SELECT upper(regexp_extract(sql_text, '(?i)EXEC\s+SQL\s+(\w+)', 1)) AS keyword FROM st) SELECT keyword, CAST(count(*) AS BIGINT) AS n FROM w WHERE keyword <> 'FOR' GROUP BY keyword")
def c11(spark, sf_dir):
    return rules.keyword_counts(statements(spark, sf_dir), "sql_text")


@query("c12_routes", ST + " SELECT CASE WHEN lower(sql_text) LIKE '%cursor%' OR lower(sql_text) LIKE '%fetch%' THEN 'cursors' WHEN lower(sql_text) LIKE '%commit%' OR lower(sql_text) LIKE '%rollback%' THEN 'transactions' ELSE 'other' END AS agent, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY 1")
def c12(spark, sf_dir):
    table = [("cursors", ["CURSOR", "fetch"]), ("transactions", ["commit", "rollback"])]
    return statements(spark, sf_dir).groupBy(rules.route(F.col("sql_text"), table, "other").alias("agent")).agg(n())


@query("c14_quality_gate", ST + r" SELECT CASE WHEN regexp_matches(sql_text, 'tmp_\w+') THEN 'HALLUCINATION' WHEN sql_text NOT LIKE '%orders%' THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY 1")
def c14(spark, sf_dir):
    return statements(spark, sf_dir).groupBy(rules.gate(F.col("sql_text"), ["orders"], [r"tmp_\w+"]).alias("verdict")).agg(n())


@query("c16_grep_lines", r"SELECT doc_id, CAST(k AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE regexp_matches(line, '(?i)licen[sc]e')")
def c16(spark, sf_dir):
    return rules.grep(read(spark, sf_dir, "documents"), "text", r"(?i)licen[sc]e", "doc_id")


_V = rf"regexp_extract_all(sql_text, '{PLAIN}')"


@query("v1_host_variables", ST + f" SELECT line_start, CAST(generate_subscripts({_V}, 1) AS BIGINT) AS pos, unnest({_V}) AS variable FROM st")
def v1(spark, sf_dir):
    return statements(spark, sf_dir).select("line_start", F.posexplode(hv.variables(F.col("sql_text"))).alias("k", "variable")).select("line_start", (F.col("k") + 1).cast("long").alias("pos"), "variable")


@query("v3_variable_forms", ST + rf""", v AS (SELECT unnest({_V}) AS x FROM st) SELECT CASE WHEN x LIKE '%.%' THEN 'struct' WHEN x LIKE '%[%' THEN 'array' ELSE 'simple' END || CASE WHEN regexp_matches(x, '.:\w+$') THEN '_indicator' ELSE '' END AS form,
 regexp_extract(x, '^:(\w+)', 1) AS var_name, regexp_extract(x, '\.(\w+)', 1) AS field, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL""")
def v3(spark, sf_dir):
    v = statements(spark, sf_dir).select(F.explode(hv.variables(F.col("sql_text"))).alias("x")).select(hv.parsed(F.col("x")).alias("p"))
    return v.groupBy(F.col("p.type").alias("form"), "p.var_name", F.coalesce("p.field_name", F.lit("")).alias("field")).agg(n())


_OUT = rf"CASE WHEN sql_type IN ('select', 'fetch_into') THEN len(regexp_extract_all(regexp_extract(sql_text, {_INTO}, 1), '{PLAIN}')) ELSE 0 END"


@query("v4_host_var_direction", TYPED + f" SELECT line_start, CAST({_OUT} AS BIGINT) AS n_out, CAST(len({_V}) - {_OUT} AS BIGINT) AS n_in FROM ty")
def v4(spark, sf_dir):
    text, kind = F.col("sql_text"), F.col("sql_type")
    return typed(spark, sf_dir).select("line_start", F.size(hv.outputs(text, kind)).cast("long").alias("n_out"), F.size(hv.inputs(text, kind)).cast("long").alias("n_in"))


@query("v8_positional_pairs", TYPED + rf", p AS (SELECT line_start, {_V} AS h FROM ty WHERE sql_type IN ('insert', 'update', 'delete')) SELECT line_start, unnest(h) AS host, '#{{' || regexp_extract(unnest(h), '^:(\w+)', 1) || '}}' AS param FROM p WHERE len(h) > 0")
def v8(spark, sf_dir):
    host = hv.variables(F.col("sql_text"))
    t = typed(spark, sf_dir).where(F.col("sql_type").isin("insert", "update", "delete")).select("line_start", host.alias("h"))
    params = F.transform("h", lambda v: F.concat(F.lit("#{"), hv.name_of(v), F.lit("}")))
    return t.select("line_start", F.inline(hv.paired(F.col("h"), params)))


@query("v9_naming_change", "SELECT DISTINCT p_brand, 'snake_to_camel' AS change FROM part")
def v9(spark, sf_dir):
    host = F.concat(F.lit(":"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("_key"))
    param = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("Key"))
    return read(spark, sf_dir, "part").select("p_brand", hv.naming_change(host, param).alias("change")).distinct()


_N1 = r"""trim(regexp_replace(regexp_replace(CASE WHEN sql_type = 'select' THEN regexp_replace(b, '(?is)\bINTO\s+:.*?\bFROM\b', 'FROM') WHEN sql_type = 'fetch_into' THEN regexp_replace(b, '(?is)\bINTO\s+.*$', '') ELSE b END, ';\s*$', ''), '\s+', ' ', 'g'))"""
_BARE = TYPED + r", ba AS (SELECT *, regexp_replace(regexp_replace(sql_text, '(?i)^\s*EXEC\s+SQL\s+', ''), '(?i)^FOR\s+:?\w+\s+', '') AS b FROM ty)"


@query("n1_normalize", _BARE + f" SELECT line_start, {_N1} AS sql FROM ba")
def n1(spark, sf_dir):
    return statements(spark, sf_dir).select("line_start", rw.normalized(F.col("sql_text")).alias("sql"))


@query("n5_parameters", ST + r" SELECT line_start, regexp_replace(regexp_replace(sql_text, ':([A-Za-z_]\w*)\.(\w+)(?::\w+)?', '#{\1_\2}', 'g'), ':([A-Za-z_]\w*)(?:\[[^\]]+\])?(?::\w+)?', '#{\1}', 'g') AS sql FROM st")
def n5(spark, sf_dir):
    text = F.col("sql_text")
    return statements(spark, sf_dir).select("line_start", rw.parameters(text, hv.variables(text)).alias("sql"))


@query("n3_mapper_sql")
def n3(spark, sf_dir):
    text, kind = F.col("sql_text"), F.col("sql_type")
    return typed(spark, sf_dir).where(kind.isin("select", "insert", "update", "delete")).select("line_start", rw.mapper_sql(text, kind, hv.outputs(text, kind), hv.inputs(text, kind)).alias("sql"))


@query("n11_select_columns", ST + r", c AS (SELECT line_start, string_split(regexp_extract(sql_text, '(?is)\bSELECT\s+(.*?)\s+(?:INTO|FROM)\b', 1), ',') AS l FROM st WHERE sql_text LIKE '%SELECT %') SELECT line_start, CAST(generate_subscripts(l, 1) AS BIGINT) AS pos, trim(unnest(l)) AS col FROM c")
def n11(spark, sf_dir):
    st = statements(spark, sf_dir).where("sql_text like '%SELECT %'")
    return st.select("line_start", F.posexplode(rw.select_columns(F.col("sql_text"))).alias("k", "col")).select("line_start", (F.col("k") + 1).cast("long").alias("pos"), "col")


@query("n13_comments_removed", r"SELECT o_orderkey, trim(regexp_replace(regexp_replace('SELECT /* c' || o_orderkey || ' */ a FROM t -- end', '/\*.*?\*/|--[^\n]*', ' ', 'g'), '\s+', ' ', 'g')) AS sql FROM orders")
def n13(spark, sf_dir):
    text = F.concat(F.lit("SELECT /* c"), F.col("o_orderkey").cast("string"), F.lit(" */ a FROM t -- end"))
    return read(spark, sf_dir, "orders").select("o_orderkey", rw.without_comments(text).alias("sql"))


@query("n14_camel_names", r"SELECT p_partkey, 'part' || upper(substr(p_brand, 1, 1)) || lower(regexp_replace(substr(p_brand, 2), '#', '')) || 'Key' AS camel FROM part WHERE NOT regexp_matches(p_brand, '[0-9][A-Za-z]')")
def n14(spark, sf_dir):
    name = F.concat(F.lit("part_"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_KEY"))
    return read(spark, sf_dir, "part").where(~F.regexp_like("p_brand", F.lit("[0-9][A-Za-z]"))).select("p_partkey", rw.camel(name).alias("camel"))


@query("n16_statement_ids", TYPED + " SELECT line_start, 'sql_' || lpad(CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_start) AS VARCHAR), 3, '0') AS sql_id, sql_type || '_' || (row_number() OVER (PARTITION BY file_id, sql_type ORDER BY line_start) - 1) AS sql_name FROM ty")
def n16(spark, sf_dir):
    return relations.statement_ids(typed(spark, sf_dir)).select("line_start", "sql_id", "sql_name")


@query("n18_xml_escape", ST + " SELECT line_start, replace(replace(replace(sql_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS sql FROM st")
def n18(spark, sf_dir):
    return statements(spark, sf_dir).select("line_start", rw.xml_escape(F.col("sql_text")).alias("sql"))


@query("h1_pipeline_applied")
def h1(spark, sf_dir):
    steps = rw.Pipeline(rw.Step("comments", 10, rw.without_comments), rw.Step("dialect", 70, rw.oracle_to_mysql), rw.Step("paging", 80, lambda c: rw.paged(c, "mysql"), lambda c: F.regexp_like(c, F.lit("(?i)SELECT"))))
    out = statements(spark, sf_dir).select("line_start", steps.run(F.col("sql_text")).alias("r"))
    return out.select("line_start", "r.sql", F.array_join("r.applied", ",").alias("applied"))


_DEL = " SELECT line_start, replace(replace(replace(replace(sql_text, 'NVL(', 'IFNULL('), 'SYSDATE', 'NOW()'), 'SUBSTR(', 'SUBSTRING('), 'DECODE(k, 1, :x1, :x2)', 'CASE k WHEN 1 THEN :x1 ELSE :x2 END') AS sql FROM st WHERE sql_text LIKE '%DELETE%'"


@query("h2_oracle_to_mysql", ST + _DEL)
def h2(spark, sf_dir):
    return statements(spark, sf_dir).where("sql_text like '%DELETE%'").select("line_start", rw.oracle_to_mysql(F.col("sql_text")).alias("sql"))


_ALL = " SELECT line_start, replace(replace(replace(replace(replace(sql_text, 'NVL(', 'IFNULL('), 'SYSDATE', 'NOW()'), 'SUBSTR(', 'SUBSTRING('), 'DECODE(k, 1, :x1, :x2)', 'CASE k WHEN 1 THEN :x1 ELSE :x2 END'), 'first_nm || last_nm', 'CONCAT(first_nm, last_nm)') AS sql FROM st"


@query("h2_oracle_to_mysql_all", ST + _ALL)
def h2_all(spark, sf_dir):
    return statements(spark, sf_dir).select("line_start", rw.oracle_to_mysql(F.col("sql_text")).alias("sql"))


@query("h4_concat_calls", ST + " SELECT line_start, replace(sql_text, 'first_nm || last_nm', 'CONCAT(first_nm, last_nm)') AS sql FROM st WHERE sql_text LIKE '%||%'")
def h4(spark, sf_dir):
    return statements(spark, sf_dir).where("sql_text like '%||%'").select("line_start", rw.concat_calls(F.col("sql_text")).alias("sql"))


@query("h5_db2_to_mysql", ST + r" SELECT line_start, regexp_replace(sql_text, '\s*FETCH\s+FIRST\s+\d+\s+ROWS?\s+ONLY', '') AS sql FROM st")
def h5(spark, sf_dir):
    return statements(spark, sf_dir).select("line_start", rw.DIALECTS["db2", "mysql"](F.col("sql_text")).alias("sql"))


@query("h8_pagination", ST + " SELECT line_start, CASE WHEN sql_text LIKE '%FETCH FIRST%' THEN sql_text ELSE sql_text || ' LIMIT #{limit} OFFSET #{offset}' END AS sql FROM st WHERE sql_text LIKE '%SELECT%'")
def h8(spark, sf_dir):
    return statements(spark, sf_dir).where("sql_text like '%SELECT%'").select("line_start", rw.paged(F.col("sql_text"), "mysql").alias("sql"))


_FN = "fn AS (SELECT file_id, 'f' || (line_start % 7) AS name, line_start AS s, line_start + 40 AS e FROM st WHERE line_start % 40 = 0)"


@query("j1_scope_interval_join", ST + ", " + _FN + " SELECT line_start, name AS function FROM (SELECT st.line_start, fn.name, row_number() OVER (PARTITION BY st.line_start ORDER BY fn.s, fn.e) AS rn FROM st LEFT JOIN fn ON fn.file_id = st.file_id AND fn.s <= st.line_start AND fn.e >= st.line_start) WHERE rn = 1")
def j1(spark, sf_dir):
    st = statements(spark, sf_dir)
    fns = st.where("line_start % 40 = 0").select("file_id", F.concat(F.lit("f"), (F.col("line_start") % 7).cast("string")).alias("name"), "line_start", (F.col("line_start") + 40).alias("line_end"))
    return relations.scoped(st.withColumn("line_end", F.col("line_start")), fns).select("line_start", "function")


@query("j4_inside_sections", ST + ", " + _FN + " SELECT line_start FROM st WHERE EXISTS (SELECT 1 FROM fn WHERE fn.file_id = st.file_id AND st.line_start BETWEEN fn.s AND fn.e)")
def j4(spark, sf_dir):
    st = statements(spark, sf_dir)
    spans = st.where("line_start % 40 = 0").select("file_id", "line_start", (F.col("line_start") + 40).alias("line_end"))
    return relations.inside_spans(st, spans).select("line_start")


_CUR = r", c AS (SELECT *, lower(regexp_extract(sql_text, '(?i)\b(?:DECLARE|OPEN|FETCH|CLOSE)\s+(\w+)', 1)) AS name FROM ty WHERE sql_type IN ('declare_cursor', 'open_cursor', 'fetch_into', 'close_cursor')), d AS (SELECT *, lead(line_start) OVER (PARTITION BY file_id, name ORDER BY line_start) AS nxt FROM c WHERE sql_type = 'declare_cursor')"


@query("j5_cursor_groups", TYPED + _CUR + """ SELECT d.name, d.line_start AS declare_line, coalesce(min(CASE WHEN c.sql_type = 'open_cursor' THEN c.line_start END), -1) AS open_line, coalesce(min(CASE WHEN c.sql_type = 'close_cursor' THEN c.line_start END), -1) AS close_line,
 CAST(count(CASE WHEN c.sql_type = 'fetch_into' THEN 1 END) AS BIGINT) AS fetches FROM d LEFT JOIN c ON c.file_id = d.file_id AND c.name = d.name AND c.line_start > d.line_start AND (d.nxt IS NULL OR c.line_start < d.nxt) GROUP BY d.name, d.line_start""")
def j5(spark, sf_dir):
    return relations.cursor_groups(typed(spark, sf_dir)).select("name", "declare_line", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("open_line", "close_line")), "fetches")


@query("j7_dynamic_groups", TYPED + r""", c AS (SELECT *, lower(regexp_extract(sql_text, '(?i)\b(?:PREPARE|EXECUTE)\s+(\w+)', 1)) AS name FROM ty WHERE sql_type IN ('prepare', 'execute')), d AS (SELECT *, lead(line_start) OVER (PARTITION BY file_id, name ORDER BY line_start) AS nxt FROM c WHERE sql_type = 'prepare')
 SELECT d.name, d.line_start AS prepare_line, CAST(count(c.line_start) AS BIGINT) AS executions FROM d LEFT JOIN c ON c.file_id = d.file_id AND c.name = d.name AND c.sql_type = 'execute' AND c.line_start > d.line_start AND (d.nxt IS NULL OR c.line_start < d.nxt) GROUP BY d.name, d.line_start""")
def j7(spark, sf_dir):
    return relations.dynamic_groups(typed(spark, sf_dir)).select("name", "prepare_line", "executions")


_J8 = TYPED + ", b AS (SELECT *, (SELECT min(x.line_start) FROM ty x WHERE x.file_id = ty.file_id AND x.sql_type IN ('commit', 'rollback') AND x.line_start > ty.line_start) AS boundary_line FROM ty WHERE sql_type NOT IN ('commit', 'rollback', 'connect'))"


@query("j8_txn_forward_asof", _J8 + " SELECT line_start, coalesce(boundary_line, -1) AS boundary_line FROM b")
def j8(spark, sf_dir):
    return relations.closing_boundary(typed(spark, sf_dir), by=("file_id",)).select("line_start", F.coalesce("boundary_line", F.lit(-1)).alias("boundary_line"))


@query("a5_array_dml", ST + " SELECT line_start, ':batch_size' AS size_var, 'ids,names' AS array_vars, 'INSERT' AS dml FROM st WHERE sql_text LIKE '%FOR :batch_size%'")
def a5(spark, sf_dir):
    return relations.array_dml(statements(spark, sf_dir)).select("line_start", "size_var", F.array_join("array_vars", ",").alias("array_vars"), "dml")


@query("a8_transaction_ids", TYPED + """, b AS (SELECT *, 'transaction_' || lpad(CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_start) AS VARCHAR), 3, '0') AS relationship_id FROM ty WHERE sql_type IN ('commit', 'rollback')),
 s AS (SELECT t.line_start, (SELECT min(x.line_start) FROM b x WHERE x.file_id = t.file_id AND x.function = t.function AND x.line_start > t.line_start) AS bl FROM ty t WHERE sql_type NOT IN ('commit', 'rollback', 'connect'))
 SELECT b.line_start AS boundary_line, relationship_id, sql_type = 'commit' AS is_commit, CAST(count(*) AS BIGINT) AS statements FROM s JOIN b ON b.line_start = s.bl GROUP BY ALL""")
def a8(spark, sf_dir):
    return relations.transactions(typed(spark, sf_dir)).select("boundary_line", "relationship_id", "is_commit", "statements")


@query("a3_merged_cursors", TYPED + " SELECT DISTINCT file_id, 'c' || file_id || '_' AS name, 'INTO :h_a, :h_b' AS into_clause FROM ty WHERE sql_type = 'fetch_into'")
def a3(spark, sf_dir):
    text = F.col("sql_text")
    fetched = typed(spark, sf_dir).where("sql_type = 'fetch_into'").select("file_id", F.regexp_extract(text, r"FETCH\s+(\w+)", 1).alias("name"), "line_start", F.transform(hv.outputs(text, F.lit("fetch_into")), lambda v: F.concat(F.lit(":"), hv.name_of(v))).alias("vars"))
    return relations.merged_cursor(fetched)


@query("a6_built_sql", "SELECT o_custkey AS file_id, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS sql_text, round(CAST(greatest(0, 1 - 0.05 * count(*)) AS DOUBLE), 4) AS confidence FROM orders GROUP BY o_custkey")
def a6(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    calls = o.select(F.col("o_custkey").alias("file_id"), F.lit("f").alias("function"), F.col("o_orderkey").alias("line_start"), F.lit("strcat").alias("name"), F.lit("buf").alias("target"), F.col("o_orderpriority").alias("value"))
    return relations.built_sql(calls).select("file_id", "sql_text", "confidence")


@query("b10_uncovered_lines", ST + ", x AS (SELECT file_id, line_start, lag(line_start) OVER (PARTITION BY file_id ORDER BY line_start) AS p FROM st) SELECT file_id, coalesce(p, 0) + 1 AS line_start, line_start - 1 AS line_end FROM x WHERE coalesce(p, 0) + 1 < line_start")
def b10(spark, sf_dir):
    st = statements(spark, sf_dir)
    return relations.uncovered(st.select("file_id", F.col("line_start").alias("line_no")), st.select("file_id", "line_start", F.col("line_start").alias("line_end")))


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source text for each file: its statements in order, with comments and strings around them."""
    body = F.concat(F.lit("int f"), F.col("line_start").cast("string"), F.lit('() {\n  char *s = "EXEC SQL no;"; /* EXEC SQL no; */\n  '), "sql_text", F.lit("\n  g(s);\n}\n"))
    return statements(spark, sf_dir).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", body.alias("b")))), lambda x: x["b"]), "").alias("content"))


@query("b1_sql_blocks", ST + " SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_start) - 1 AS INTEGER) AS seq, sql_text AS raw FROM st")
def b1(spark, sf_dir):
    return scan_files(source_texts(spark, sf_dir), "sql").select("file_id", "seq", "raw")


@query("b3_comments", ST + " SELECT file_id, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY file_id")
def b3(spark, sf_dir):
    return scan_files(source_texts(spark, sf_dir), "comment").groupBy("file_id").agg(n())


@query("b11_c_elements", ST + " SELECT kind, CAST(count(*) AS BIGINT) AS n FROM st, (SELECT unnest(['function', 'function_call', 'variable']) AS kind) GROUP BY kind")
def b11(spark, sf_dir):
    return scan_files(source_texts(spark, sf_dir), "c").groupBy("kind").agg(n())


@query("b16_chunks")
def b16(spark, sf_dir):
    return scan_files(read(spark, sf_dir, "documents"), "chunk", "doc_id", "text").select("doc_id", "chunk", "start", "end")


@query("k4_static_prechecks", ST + " SELECT file_id, CAST(3 * count(*) AS BIGINT) AS in_text, CAST(count(*) AS BIGINT) AS extracted, false AS agree FROM st GROUP BY file_id")
def k4(spark, sf_dir):
    texts = source_texts(spark, sf_dir)
    return checks.static_prechecks(texts, scan_files(texts, "sql"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("sql_text")
    return statements(spark, sf_dir).select(F.col("file_id").alias("file"), "line_start", text.alias("sql"), rw.parameters(rw.normalized(text), hv.variables(text)).alias("parsed_sql"))


@query("k1_conversion_checks")
def k1(spark, sf_dir):
    return checks.conversion_checks(_pairs(spark, sf_dir)).groupBy("check", "status").agg(n())


@query("k2_check_totals")
def k2(spark, sf_dir):
    totals = checks.check_totals(checks.conversion_checks(_pairs(spark, sf_dir)))
    return totals.withColumn("file", F.coalesce(F.col("file").cast("string"), F.lit("all")))


@query("k3_token_diffs")
def k3(spark, sf_dir):
    return checks.token_diffs(_pairs(spark, sf_dir)).select("line_start", "similarity", "replaced", "deleted", "inserted")


@query("w3_sampler", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY length(o_orderpriority) DESC, o_orderkey) AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, count(*) OVER (PARTITION BY o_custkey) AS n,
 max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS bad FROM orders) SELECT o_custkey, o_orderkey, reason FROM (SELECT *, CASE WHEN l <= 2 THEN 'longest' WHEN a = 1 THEN 'first' WHEN a = n THEN 'last' WHEN bad = 1 AND a = floor(n / 2) + 1 THEN 'middle' END AS reason FROM r) WHERE reason IS NOT NULL""")
def w3(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return checks.sampled(o, "o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", "reason")


@query("x1_keywords_lost", ST + " SELECT line_start, 'SET,WHERE' AS lost FROM st WHERE sql_text LIKE '%UPDATE%'")
def x1(spark, sf_dir):
    text = F.col("sql_text")
    lost = F.array_except(checks.keywords_of(text), checks.keywords_of(F.regexp_replace(text, r"\b(?:SET|WHERE)\b", " ")))
    return statements(spark, sf_dir).where("sql_text like '%UPDATE%'").select("line_start", F.array_join(F.array_sort(lost), ",").alias("lost"))


_CALLS = "SELECT p_partkey AS source_id, CAST(floor(p_partkey / 3) AS BIGINT) AS target_id FROM part WHERE p_partkey >= 3"


@query("g1_include_closure", f"WITH RECURSIVE e AS ({_CALLS}), w(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 7 UNION ALL SELECT e.target_id, depth + 1 FROM w JOIN e ON e.source_id = node) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node")
def g1(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    edges = part.where("p_partkey >= 3").select(F.col("p_partkey").alias("source_id"), F.floor(F.col("p_partkey") / 3).cast("long").alias("target_id"))
    return graphs.closure(edges, part.where("p_size = 7").select(F.col("p_partkey").alias("node")))


@query("g3_call_chain", f"WITH RECURSIVE e AS ({_CALLS}), w(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size = 7 UNION ALL SELECT root, e.target_id, depth + 1 FROM w JOIN e ON e.source_id = node WHERE depth < 10) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY root, node")
def g3(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    edges = part.where("p_partkey >= 3").select(F.col("p_partkey").alias("source_id"), F.floor(F.col("p_partkey") / 3).cast("long").alias("target_id"))
    return graphs.call_chains(edges, part.where("p_size = 7").select(F.col("p_partkey").alias("node")))


@query("g2_external_nodes", "SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def g2(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return graphs.externals(edges, read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")))


@query("j13_name_match_ladder", "SELECT a.c_custkey AS source_id, b.c_custkey AS target_id, 'USED_IN' AS link_type, CAST(0.95 AS DOUBLE) AS confidence, 'lower' AS rule FROM customer a JOIN customer b ON a.c_name = b.c_name")
def j13(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return graphs.name_links(c.select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name")), c.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name")), "USED_IN")


@query("j18_upstream", "SELECT l_partkey AS node, l_suppkey AS neighbour FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size = 7")
def j18(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return graphs.neighbours(edges, read(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("node")), up=True)


@query("a10_type_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def a10(spark, sf_dir):
    return graphs.type_counts(read(spark, sf_dir, "events"), "event_type")


@query("a13_common_headers", "SELECT l_partkey AS target_id FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 2")
def a13(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return graphs.common_targets(edges, read(spark, sf_dir, "supplier").where("s_suppkey in (1, 2)").select(F.col("s_suppkey").alias("node")))


@query("a17_partial_final_counts", "SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def a17(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(n(), F.sum(F.length("text")).alias("chars"))


_NOTE = "concat(s_name, ' in nation', s_nationkey, ' nation', s_nationkey, '. owner', CAST(floor(s_suppkey / 4) AS INT))"


@query("j28_similar_issues", rf"WITH w AS (SELECT DISTINCT s_suppkey AS id, unnest(regexp_split_to_array(lower({_NOTE}), '\W+')) AS word FROM supplier), s AS (SELECT id, count(*) AS n FROM w WHERE word <> '' GROUP BY id), p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM w x JOIN w y ON x.word = y.word AND x.word <> '' AND x.id < y.id GROUP BY ALL) SELECT a, b, k / CAST(least(sa.n, sb.n) AS DOUBLE) AS overlap FROM p JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b WHERE k / CAST(least(sa.n, sb.n) AS DOUBLE) > 0.5")
def j28(spark, sf_dir):
    return graphs.similar_issues(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_NOTE).alias("text")))


@query("s17_cypher", "SELECT 0 AS ord, 'CREATE (:Nation {id: ''' || n_nationkey || ''', name: ''' || n_name || '''});' AS value FROM nation UNION ALL SELECT 1, 'MATCH (a {id: ''' || n_nationkey || '''}), (b {id: ''' || n_regionkey || '''}) CREATE (a)-[:IN]->(b);' FROM nation")
def s17(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("node_type"))
    links = nation.select(F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_regionkey").cast("string").alias("target_id"), F.lit("IN").alias("link_type"))
    return sinks.cypher_statements(nodes, links)


@query("s21_mapper_texts")
def s21(spark, sf_dir):
    text, kind = F.col("sql_text"), F.col("sql_type")
    st = relations.statement_ids(typed(spark, sf_dir).where(kind.isin("select", "insert", "update", "delete")))
    return sinks.mapper_texts(st.select("file_id", "line_start", "sql_name", rules.tag(kind).alias("tag"), rw.mapper_sql(text, kind, hv.outputs(text, kind), hv.inputs(text, kind)).alias("sql")), "app", "2024-01-01")


@query("j6_last_wins_cursors", TYPED + r""", c AS (SELECT *, lower(regexp_extract(sql_text, '(?i)\b(?:DECLARE|OPEN|FETCH|CLOSE)\s+(\w+)', 1)) AS name FROM ty) SELECT name, max(CASE WHEN sql_type = 'declare_cursor' THEN line_start END) AS declare_line,
 CAST(count(CASE WHEN sql_type = 'fetch_into' THEN 1 END) AS BIGINT) AS fetches, count(CASE WHEN sql_type = 'fetch_into' THEN 1 END) > 1 AS is_loop FROM c WHERE name <> '' GROUP BY file_id, name HAVING declare_line IS NOT NULL""")
def j6(spark, sf_dir):
    return context.last_wins_cursors(typed(spark, sf_dir)).select("name", "declare_line", "fetches", "is_loop")


@query("j16_derived_names", "SELECT lower(c_mktsegment) || 'Id' AS java_name, 'h_' || lower(c_mktsegment) || '_id,w_' || lower(c_mktsegment) || '_id' AS source_names FROM customer GROUP BY c_mktsegment")
def j16(spark, sf_dir):
    seg = F.lower("c_mktsegment")
    names = read(spark, sf_dir, "customer").select(F.explode(F.array(*(F.concat(F.lit(p), seg, F.lit("_id")) for p in ("h_", "w_")))).alias("name"))
    return context.java_names(names, ("h_", "w_")).select("java_name", F.array_join("source_names", ",").alias("source_names"))


@query("a14_adjacency", "SELECT n_regionkey AS source_id, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS targets FROM nation GROUP BY n_regionkey")
def a14(spark, sf_dir):
    edges = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("source_id"), F.col("n_nationkey").alias("target_id"))
    return context.adjacency(edges)[0].select("source_id", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query("a18_latest_macros", "SELECT o_orderpriority AS name, CAST(max(o_orderkey) AS VARCHAR) AS value FROM orders GROUP BY o_orderpriority")
def a18(spark, sf_dir):
    macros = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("file_ord"))
    return context.latest_macros(macros, numeric=True)


@query("a11_use_summary", "SELECT event_type AS variable_name, CAST(count(DISTINCT CASE WHEN user_id % 2 = 0 THEN user_id END) AS BIGINT) AS n_read, CAST(count(DISTINCT CASE WHEN user_id % 2 = 1 THEN user_id END) AS BIGINT) AS n_write FROM events GROUP BY event_type")
def a11(spark, sf_dir):
    uses = read(spark, sf_dir, "events").select(F.col("event_type").alias("variable_name"), F.when(F.col("user_id") % 2 == 0, "read").otherwise("write").alias("use_type"), F.col("user_id").alias("line"))
    return context.use_summary(uses).select("variable_name", F.size("read").cast("long").alias("n_read"), F.size("write").cast("long").alias("n_write"))


@query("a16_stage_verdicts", "SELECT o_orderpriority AS stage, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS failed, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) = 0 AS passed FROM orders GROUP BY o_orderpriority")
def a16(spark, sf_dir):
    results = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "P", "fail").otherwise("pass").alias("status"))
    return context.verdicts(results)


@query("b18_line_slice", "SELECT doc_id AS file_id, CAST(k AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE k BETWEEN 2 AND 4")
def b18(spark, sf_dir):
    return text.line_slice(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")), 2, 4)


@query("n17_spliced_markers", ST + " SELECT file_id, string_agg('int f' || line_start || '() {' || chr(10) || '  char *s = \"EXEC SQL no;\"; /* EXEC SQL no; */' || chr(10) || '  /* @sql ' || line_start || ' x */' || chr(10) || '  g(s);' || chr(10) || '}' || chr(10), '' ORDER BY line_start) AS content FROM st GROUP BY file_id")
def n17(spark, sf_dir):
    texts = source_texts(spark, sf_dir)
    line = F.regexp_extract("name", "[0-9]+", 0)
    found = scan_files(texts, "outline", fields=("kind", "name", "start", "end", "line_start"))
    is_sql = F.col("kind") == "sql"
    # a block belongs to the functions that begin two lines before it: both kinds meet in one shuffle, as a join would scan twice
    at = F.when(is_sql, F.col("line_start") - 2).otherwise(F.col("line_start")).alias("line_start")
    met = found.groupBy("file_id", at).agg(F.collect_list(F.when(is_sql, F.struct("start", "end"))).alias("b"), F.collect_list(F.when(~is_sql, line)).alias("ids"))
    blocks = met.select("file_id", F.explode("b").alias("b"), "ids").select("file_id", "b.*", F.explode("ids").alias("id"))
    return text.spliced(texts, blocks.select("file_id", "start", "end", text.marker(F.col("id"), F.lit("x")).alias("marker")))


@query("k8_java_merge")
def k8(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("class_id"), F.lit("package p;\npublic class A {\n}\n").alias("skeleton"), F.format_string("public int m%d() { return %d; }", F.col("o_orderkey") % 3, F.col("o_orderkey")).alias("llm_response"), F.col("o_orderkey").alias("ord"))
    return java.merge_classes(rows, every=True)


@query("j26_function_contexts")
def j26(spark, sf_dir):
    texts = source_texts(spark, sf_dir)
    c = stored(scan_files(texts, "c"))  # read more than once
    fns = c.where("kind = 'function'").select("file_id", "name", "line_start", "line_end")
    owned = relations.scoped(scan_files(texts, "sql").select("file_id", "line_start", "line_end", "raw"), fns).withColumn("sql_type", rules.sql_type(F.col("raw")))
    held = relations.scoped(c.where("kind = 'variable'").select("file_id", "line_start", "line_end", "name", "data_type"), fns)
    calls = c.where("kind = 'function_call'").select("file_id", F.col("parent").alias("function"), "name")
    return context.prompt_text(context.function_contexts(fns, held, owned, calls))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file and function: statements by kind, variables in and out, and how many a boundary closes."""
    text, kind = F.col("sql_text"), F.col("sql_type")
    return (
        relations.closing_boundary(typed(spark, sf_dir))
        .groupBy("file_id", "function", "sql_type")
        .agg(n(), F.sum(F.size(hv.inputs(text, kind))).alias("n_in"), F.sum(F.size(hv.outputs(text, kind))).alias("n_out"), F.count("boundary_line").alias("closed"))
    )


QUERIES["flagship"] = flagship
ORACLES["flagship"] = TYPED + f""" SELECT file_id, function, sql_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(len({_V}) - {_OUT}) AS BIGINT) AS n_in, CAST(sum({_OUT}) AS BIGINT) AS n_out,
 CAST(count((SELECT min(x.line_start) FROM ty x WHERE x.file_id = ty.file_id AND x.function = ty.function AND x.sql_type IN ('commit', 'rollback') AND x.line_start > ty.line_start)) AS BIGINT) AS closed
 FROM ty WHERE sql_type NOT IN ('commit', 'rollback', 'connect') GROUP BY file_id, function, sql_type"""
