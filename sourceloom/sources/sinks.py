"""Writing elements, graphs, mapper and descriptor texts, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewrite import camel, class_name, xml_escape


def write_elements(elements: DataFrame, path: str) -> None:
    """JSON lines, one folder for each element type; a run replaces what was there."""
    elements.write.mode("overwrite").partitionBy("type").json(path)


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON record for each node and edge, as ``value``."""
    as_json = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("record_type"), *df.columns)).alias("value"))
    return as_json(nodes, "node").union(as_json(edges, "edge"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Graphviz graph with their order, as (ord, value)."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit("  "), q("id"), F.lit(" [label="), q("name"), F.lit("];")).alias("value"))
    links = edges.select(F.lit(2).alias("ord"), F.concat(F.lit("  "), q("source_id"), F.lit(" -> "), q("target_id"), F.lit(" [label="), q("edge_type"), F.lit("];")).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph g {"), (3, "}")], "ord int, value string")
    return ends.union(body).union(links)


def cypher_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))


def cypher_statements(nodes: DataFrame, links: DataFrame, merge: bool = False) -> DataFrame:
    """CREATE or MERGE statements for nodes, then links, as (ord, value); a merge binds its node before setting properties."""
    t = lambda c: F.concat(F.lit("'"), cypher_text(F.col(c)), F.lit("'"))
    if merge:
        node = F.concat(F.lit("MERGE (n:"), F.col("node_type"), F.lit(" {id: "), t("id"), F.lit("}) SET n.name = "), t("name"), F.lit(";"))
    else:
        node = F.concat(F.lit("CREATE (:"), F.col("node_type"), F.lit(" {id: "), t("id"), F.lit(", name: "), t("name"), F.lit("});"))
    link = F.concat(F.lit("MATCH (a {id: "), t("source_id"), F.lit("}), (b {id: "), t("target_id"), F.lit("}) "), F.lit("MERGE" if merge else "CREATE"), F.lit(" (a)-[:"), F.col("link_type"), F.lit("]->(b);"))
    return nodes.select(F.lit(0).alias("ord"), node.alias("value")).union(links.select(F.lit(1).alias("ord"), link.alias("value")))


def _ordered(rows: Column, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, rows.alias("_t")))), lambda s: s["_t"]), "\r\n")


def omm_texts(fields: DataFrame) -> DataFrame:
    """struct_name and text: a descriptor of each struct's fields in order, CRLF line ends."""
    kind = F.when(F.col("dtype").isin("int", "short"), "Integer").when(F.col("dtype").isin("long", "double", "float"), "BigDecimal").otherwise("String")
    line = F.concat(F.lit("\t"), kind, F.lit(" "), camel(F.col("name")), F.lit("<length="), F.col("size").cast("string"), F.when(F.col("decimal") > 0, F.concat(F.lit(" decimal="), F.col("decimal").cast("string"))).otherwise(""), F.lit(' description="'), F.coalesce("description", "name"), F.lit('">;'))
    body = fields.groupBy("struct_name").agg(_ordered(line, "ordinal").alias("_b"))
    return body.select("struct_name", F.concat(F.lit("OMM "), class_name(F.col("struct_name")), F.lit("\r\n{\r\n"), "_b", F.lit("\r\n}\r\n")).alias("text"))


def mapper_texts(statements: DataFrame, namespace: str, stamp: str) -> DataFrame:
    """file_id and text: a mapper of each file's statements (tag, sql_name, sql) in order of line; the time is a parameter."""
    one = F.concat(F.lit("  <"), F.col("tag"), F.lit(' id="'), F.col("sql_name"), F.lit('">\r\n    '), xml_escape(F.col("sql")), F.lit("\r\n  </"), F.col("tag"), F.lit(">"))
    body = statements.groupBy("file_id").agg(_ordered(one, "line_start").alias("_b"))
    return body.select("file_id", F.concat(F.lit(f"<!-- {stamp} -->\r\n<mapper namespace=\"{namespace}\">\r\n"), "_b", F.lit("\r\n</mapper>\r\n")).alias("text"))


def markdown_report(totals: DataFrame) -> DataFrame:
    """Lines of a table of passes, failures and warnings by file, the whole last, as (ord, value)."""
    row = F.format_string("| %s | %d | %d | %d |", F.coalesce("file", F.lit("all")), "n_pass", "n_fail", "n_warning")
    head = totals.sparkSession.createDataFrame([(0, "| file | pass | fail | warning |"), (1, "|---|---|---|---|")], "ord int, value string")
    return head.union(totals.select(F.when(F.col("file").isNull(), 3).otherwise(2).alias("ord"), row.alias("value")))


def sql_calls_yaml(stmts: DataFrame) -> DataFrame:
    """file_id, yaml: a file's statements (sql_id, sql_type, line_start, sql_text) as YAML, texts as literal blocks."""
    block = F.concat(F.lit("- sql_id: "), "sql_id", F.lit("\n  sql_type: "), "sql_type", F.lit("\n  sql: |\n    "), F.replace("sql_text", F.lit("\n"), F.lit("\n    ")), F.lit("\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_start", block.alias("b")))), lambda x: x["b"])
    return stmts.groupBy("file_id").agg(F.concat(F.lit("sql_calls:\n"), F.array_join(ordered, "")).alias("yaml"))


def section_files(sections: DataFrame) -> DataFrame:
    """file_id, name, body: declare sections (seq, raw) as files of their own."""
    return sections.select("file_id", F.format_string("declare_section_%d.c", F.col("seq")).alias("name"), F.col("raw").alias("body"))


def report_lines(rows: DataFrame, title: str) -> DataFrame:
    """(ord, name, value): the page of ``report_html`` by lines, sorted by ord and name, for reports of any length."""
    esc = lambda c: xml_escape(F.coalesce(c, F.lit("")))
    line = F.concat(F.lit("<tr><td>"), esc(F.col("name")), F.lit('</td><td class="'), "status", F.lit('">'), "status", F.lit("</td><td>"), esc(F.col("message")), F.lit("</td></tr>"))
    ends = rows.sparkSession.createDataFrame([(0, "", f"<html><head><title>{title}</title></head><body><table>"), (2, "", "</table></body></html>")], "ord int, name string, value string")
    return ends.union(rows.select(F.lit(1).alias("ord"), "name", line.alias("value")))


def report_html(rows: DataFrame, title: str) -> DataFrame:
    """html: a report of rows (name, status, message) as one page, in order of names; one row, so for short reports (else ``report_lines``)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr><td>"), esc(F.col("name")), F.lit('</td><td class="'), "status", F.lit('">'), "status", F.lit("</td><td>"), esc(F.col("message")), F.lit("</td></tr>"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("l")))), lambda x: x["l"])
    return rows.agg(F.concat(F.lit(f"<html><head><title>{title}</title></head><body><table>"), F.array_join(ordered, ""), F.lit("</table></body></html>")).alias("html"))


#: statements that prepare a graph store: a unique id for each label, an index on names
def store_schema(labels: tuple[str, ...]) -> list[str]:
    return [f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{x}) REQUIRE n.id IS UNIQUE;" for x in labels] + [f"CREATE INDEX IF NOT EXISTS FOR (n:{x}) ON (n.name);" for x in labels]


def write_texts(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file under ``path`` for each row (name, content): all of them, or none where the job fails."""
    from .formats import register

    register(rows.sparkSession)
    rows.select("name", "content").write.format("text_files").mode("overwrite" if overwrite else "append").save(path)


def safe_name(c: Column) -> Column:
    """A text as a file name: signs that are none become underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def write_mappers(statements: DataFrame, namespace: str, stamp: str, path: str) -> None:
    """``<file>.xml`` for each file's statements."""
    write_texts(mapper_texts(statements, namespace, stamp).select(F.concat(safe_name(F.col("file_id").cast("string")), F.lit(".xml")).alias("name"), F.col("text").alias("content")), path)


def write_descriptors(fields: DataFrame, path: str) -> None:
    """``<Class>.omm`` for each struct."""
    write_texts(omm_texts(fields).select(F.concat(class_name(F.col("struct_name")), F.lit(".omm")).alias("name"), F.col("text").alias("content")), path)


def write_sections(sections: DataFrame, path: str) -> None:
    """``<file>/declare_section_<n>.c`` for each declare section."""
    write_texts(section_files(sections).select(F.concat(safe_name(F.col("file_id").cast("string")), F.lit("/"), "name").alias("name"), F.col("body").alias("content")), path)


def write_sql_calls(stmts: DataFrame, path: str) -> None:
    """``<file>/sql_calls.yaml`` for each file."""
    write_texts(sql_calls_yaml(stmts).select(F.concat(safe_name(F.col("file_id").cast("string")), F.lit("/sql_calls.yaml")).alias("name"), F.col("yaml").alias("content")), path)


def item_yaml(items: DataFrame) -> DataFrame:
    """file and yaml: reviewed pairs (file, idx, sql, parsed_sql, status, comment) of each file, texts as literal blocks."""
    block = lambda k, c: F.concat(F.lit(f"  {k}: |-\n    "), F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("\n    ")), F.lit("\n"))
    quoted = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {k}: "), F.to_json(F.struct(F.col(c).alias("v"))).substr(6, 1 << 20).substr(F.lit(1), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6), F.lit("\n"))).otherwise("")
    one = F.concat(F.lit("- idx: "), F.col("idx").cast("string"), F.lit("\n"), block("sql", F.col("sql")), block("parsed_sql", F.col("parsed_sql")), quoted("status", "status"), quoted("comment", "comment"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("b")))), lambda x: x["b"])
    return items.groupBy("file").agg(F.array_join(ordered, "").alias("yaml"))


def write_items(items: DataFrame, path: str, folders: int = 0) -> None:
    """``<file>.yaml`` for each file's reviewed pairs; ``conversion_pairs`` reads them back. Many files go to so many ``folders``."""
    name = F.concat(safe_name(F.col("file")), F.lit(".yaml"))
    write_texts(item_yaml(items).select((F.concat(F.pmod(F.hash(name), F.lit(folders)), F.lit("/"), name) if folders else name).alias("name"), F.col("yaml").alias("content")), path)


def write_marked(files: DataFrame, blocks: DataFrame, path: str) -> None:
    """Each source with its SQL blocks (start, end, marker) replaced by markers, under its own name."""
    from ..functions.text import spliced

    write_texts(spliced(files, blocks).select(safe_name(F.col("file_id").cast("string")).alias("name"), "content"), path)


def write_session(items: DataFrame, path: str) -> None:
    """Statuses and comments (idx, status, comment) as one JSON record, as ``files.session_items`` reads it."""
    held = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("idx").cast("string"), F.col(c))))))
    items.agg(held("status").alias("statuses"), held("comment").alias("comments")).coalesce(1).write.mode("overwrite").json(path)
