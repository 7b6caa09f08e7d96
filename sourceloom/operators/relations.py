"""Relationships between statements, and between statements and functions.

Statements have file_id, function, line_start, sql_type, sql_text. Every join is
by file (and name or function); what remains is a range or a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import sqltree
from ..session import ship


def _range(elements: DataFrame, start_only: bool) -> tuple[Column, Column]:
    end = F.col("line_start") if start_only or "line_end" not in elements.columns else F.coalesce("line_end", "line_start")
    return F.col("line_start").cast("long"), end.cast("long")


def scoped(elements: DataFrame, functions: DataFrame, start_only: bool = False, innermost: bool = False) -> DataFrame:
    """Each element with the function whose lines hold it (``function``: null outside all, or where the element has no line).

    The first such function by (start, end), or the innermost: the last one to
    start, of those the first to end. ``start_only`` looks at an element's first
    line; so does an element without a last line, or with one before its first.

    No pairs are made. First: of the functions of a file only those that end after
    all earlier ones matter, and the first of them to end at or after an element is
    found by one window over ends. Innermost: one sweep over starts, with a stack
    of what is open.
    """
    return _innermost(elements, functions, start_only) if innermost else _first(elements, functions, start_only)


def _first(elements: DataFrame, functions: DataFrame, start_only: bool) -> DataFrame:
    by_start = Window.partitionBy("_file").orderBy("_s", "_e", "_name")
    spans = functions.select(F.col("file_id").alias("_file"), F.col("line_start").cast("long").alias("_s"), F.col("line_end").cast("long").alias("_e"), F.col("name").alias("_name")).where("_s is not null and _e is not null")
    before = F.max("_e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    latest = spans.withColumn("_before", before).where("_before is null or _e > _before").select("_file", F.col("_e").alias("_at"), F.struct("_s", "_name").alias("_span"))
    start, end = _range(elements, start_only)
    row = F.struct(*(F.col(f"`{c}`") for c in elements.columns)).alias("_row")
    asked = elements.select(F.col("file_id").alias("_file"), F.greatest(start, end).alias("_at"), row)
    both = asked.unionByName(latest, allowMissingColumns=True)
    down = Window.partitionBy("_file").orderBy(F.desc("_at"), F.col("_span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_span", True).over(down)).where("_row is not null")
    inside = F.when(F.col("_found._s") <= F.col("_row.line_start"), F.col("_found._name"))
    return found.select(*(F.col("_row").getField(c).alias(c) for c in elements.columns if c != "function"), inside.alias("function"))


def _innermost(elements: DataFrame, functions: DataFrame, start_only: bool) -> DataFrame:
    kept = [c for c in elements.columns if c != "function"]
    start, end = _range(elements, start_only)
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row")
    spans = functions.select(F.col("file_id").alias("_file"), F.col("line_start").cast("long").alias("_s"), F.col("line_end").cast("long").alias("_e"), F.col("name").alias("_name")).where("_s is not null and _e is not null")
    both = elements.select(F.col("file_id").alias("_file"), start.alias("_s"), F.greatest(start, end).alias("_e"), row).unionByName(spans, allowMissingColumns=True)
    asked = F.col("_row").isNotNull().alias("_asked")
    n = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.select("*", asked).repartition(n, "_file").sortWithinPartitions("_file", "_s", "_asked", F.desc("_e"), F.desc("_name"))
    schema = T.StructType([T.StructField("_row", both.schema["_row"].dataType), T.StructField("function", T.StringType())])
    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, []
        for batch in batches:
            held, names = batch.column("_row"), []
            for f, s, e, name, is_asked in zip(*(batch.column(c).to_pylist() for c in ("_file", "_s", "_e", "_name", "_asked"))):
                if f != file:
                    file, opened = f, []
                while s is not None and opened and opened[-1][0] < s:
                    opened.pop()
                if is_asked:
                    names.append(next((n for end, n in reversed(opened) if end >= e), None) if s is not None else None)
                else:
                    opened.append((e, name))
            yield pa.RecordBatch.from_arrays([held.filter(batch.column("_asked")), pa.array(names, pa.string())], schema=arrow)

    ship(elements.sparkSession)
    found = dealt.mapInArrow(sweep, schema)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in kept), "function")


def inside_spans(elements: DataFrame, spans: DataFrame) -> DataFrame:
    """Elements whose first line lies in some span of their file."""
    row = F.struct(*(F.col(f"`{c}`") for c in elements.columns)).alias("_own")
    asked = elements.select("file_id", "line_start", row)
    return scoped(asked, spans.select("file_id", "line_start", "line_end", F.lit("in").alias("name")), start_only=True).where("function is not null").select(*(F.col("_own").getField(c).alias(c) for c in elements.columns))


_CURSOR = r"(?i)\b(?:DECLARE|OPEN|FETCH|CLOSE)\s+(\w+)"
_PREPARED = r"(?i)\b(?:PREPARE|EXECUTE|DEALLOCATE\s+PREPARE)\s+(?!IMMEDIATE\b)(\w+)"


def _named(stmts: DataFrame, pattern: str) -> DataFrame:
    return stmts.withColumn("name", F.lower(F.regexp_extract("sql_text", pattern, 1))).where("name <> ''")


def cursor_groups(stmts: DataFrame) -> DataFrame:
    """A row for each declared cursor: first OPEN, all FETCH and first CLOSE after it, by whole name.

    ``is_loop``: more than one FETCH; ``reads_rows``: that, or a FETCH with outputs.

    One pass over each (file, cursor name): a later DECLARE of the name starts a
    new group, so the join with all later statements becomes a running count.
    """
    # the words first: a kind may be a long ladder of rules
    worded = stmts.where(F.regexp_like("sql_text", F.lit(r"(?i)\b(?:DECLARE|OPEN|FETCH|CLOSE)\b")))
    named = _named(worded.where(F.col("sql_type").isin("declare_cursor", "open_cursor", "fetch_into", "close_cursor")), _CURSOR)
    order = Window.partitionBy("file_id", "name").orderBy("line_start")
    grouped = named.withColumn("decl", F.sum((F.col("sql_type") == "declare_cursor").cast("long")).over(order)).where("decl > 0")
    first = lambda kind: F.min(F.when(F.col("sql_type") == kind, F.col("line_start")))
    return grouped.groupBy("file_id", "name", "decl").agg(
        first("declare_cursor").alias("declare_line"),
        first("open_cursor").alias("open_line"),
        first("close_cursor").alias("close_line"),
        F.count(F.when(F.col("sql_type") == "fetch_into", 1)).alias("fetches"),
        F.coalesce(F.bool_or(F.when(F.col("sql_type") == "fetch_into", F.regexp_like("sql_text", F.lit(r"(?is)\bINTO\s+:")))), F.lit(False)).alias("_out"),
    ).select("file_id", "name", "decl", "declare_line", "open_line", "close_line", "fetches", (F.col("fetches") > 1).alias("is_loop"), ((F.col("fetches") > 1) | F.col("_out")).alias("reads_rows"), numbered_id("cursor", F.col("name"), F.col("decl")).alias("relationship_id"))


def dynamic_groups(stmts: DataFrame) -> DataFrame:
    """A row for each PREPARE: the EXECUTE statements and the first DEALLOCATE that follow it by name, up to the next PREPARE."""
    freed = F.regexp_like("sql_text", F.lit(r"(?i)\bDEALLOCATE\s+PREPARE\b"))
    kind = F.when(freed, "deallocate").otherwise(F.col("sql_type"))
    named = _named(stmts.withColumn("_kind", kind).where(F.col("_kind").isin("prepare", "execute", "deallocate")), _PREPARED)
    order = Window.partitionBy("file_id", "name").orderBy("line_start")
    grouped = named.withColumn("prep", F.sum((F.col("_kind") == "prepare").cast("long")).over(order)).where("prep > 0")
    first = lambda k: F.min(F.when(F.col("_kind") == k, F.col("line_start")))
    return grouped.groupBy("file_id", "name", "prep").agg(
        first("prepare").alias("prepare_line"), F.count(F.when(F.col("_kind") == "execute", 1)).alias("executions"), first("deallocate").alias("deallocate_line")
    ).withColumn("relationship_id", numbered_id("dynamic_sql", F.col("name"), F.col("prep")))


BOUNDARIES = ("commit", "rollback")


def closing_boundary(stmts: DataFrame, by: tuple[str, ...] = ("file_id", "function")) -> DataFrame:
    """Each other statement with the first commit or rollback on a later line of its function, and whether a rollback follows that.

    A forward as-of join as one window: from the last line up, the least boundary
    so far, which grows with the frame and is not computed anew for each row.
    """
    after = Window.partitionBy(*by).orderBy(F.desc("line_start")).rangeBetween(Window.unboundedPreceding, -1)
    boundary = F.when(F.col("sql_type").isin(*BOUNDARIES), F.col("line_start"))
    rollback = F.when(F.col("sql_type") == "rollback", F.col("line_start"))
    return (
        stmts.withColumn("boundary_line", F.min(boundary).over(after))
        .withColumn("has_rollback", F.coalesce(F.max(rollback).over(Window.partitionBy(*by)) > F.col("boundary_line"), F.lit(False)))
        .where(~F.col("sql_type").isin(*BOUNDARIES, "connect"))
    )


def transactions(stmts: DataFrame) -> DataFrame:
    """A row for each boundary with statements before it: how many, whether a rollback follows, and its id by ordinal in the file."""
    closed = closing_boundary(stmts).where("boundary_line is not null").groupBy("file_id", "function", "boundary_line").agg(F.count(F.lit(1)).alias("statements"), F.bool_or("has_rollback").alias("has_rollback"))
    ordinal = Window.partitionBy("file_id").orderBy("line_start")
    numbered = stmts.where(F.col("sql_type").isin(*BOUNDARIES)).withColumn("ordinal", F.row_number().over(ordinal))
    ends = numbered.select("file_id", F.col("line_start").alias("boundary_line"), (F.col("sql_type") == "commit").alias("is_commit"), F.format_string("transaction_%03d", F.col("ordinal")).alias("relationship_id"))
    return closed.join(ends, ["file_id", "boundary_line"])


def numbered_id(kind: str, name: Column, ordinal: Column) -> Column:
    """The id of a relationship: kind, name and its number, in three places."""
    return F.format_string("%s_%s_%03d", F.lit(kind), name, ordinal.cast("long"))


def array_dml(stmts: DataFrame) -> DataFrame:
    """Statements with an array clause: its size, the subscripted variables, the kind of change."""
    text = F.col("sql_text")
    hit = F.regexp_like(text, F.lit(r"(?i)\bFOR\s+(?::\w+|\d+)\s+(?:INSERT|UPDATE|DELETE)\b"))
    return stmts.where(hit).select(
        "file_id",
        "line_start",
        F.regexp_extract(text, r"(?i)\bFOR\s+(:\w+|\d+)", 1).alias("size_var"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r":(\w+)\["), F.lit(1))).alias("array_vars"),
        F.upper(F.regexp_extract(text, r"(?i)\b(INSERT|UPDATE|DELETE)\b", 1)).alias("dml"),
        numbered_id("array", F.coalesce("function", F.lit("unknown")), F.row_number().over(Window.partitionBy("file_id").orderBy("line_start"))).alias("relationship_id"),
    )


def write_back(stmts: DataFrame, members: DataFrame) -> DataFrame:
    """Statements with the relationship of the last plugin that claims them.

    ``members``: file_id, line_start, relationship_id, plugin_order, sequence, total.
    """
    best = members.groupBy("file_id", "line_start").agg(F.max_by(F.struct("relationship_id", "sequence", "total"), F.struct("plugin_order", "relationship_id")).alias("relationship"))
    return stmts.join(best, ["file_id", "line_start"], "left")


def merged_cursor(fetch_vars: DataFrame) -> DataFrame:
    """file_id, name, into_clause: variables of all fetches in order, without repeats, colons added once."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "vars"))), lambda s: s["vars"]))
    bare = F.transform(F.array_distinct(ordered), lambda v: F.concat(F.lit(":"), F.regexp_replace(v, "^:", "")))
    return fetch_vars.groupBy("file_id", "name").agg(F.concat(F.lit("INTO "), F.array_join(bare, ", ")).alias("into_clause"))


def merged_cursor_sql(declare: Column, into_clause: Column) -> Column:
    """A declared cursor's query with the INTO clause of its fetches before the FROM of its own level, or at its end."""
    query = F.regexp_replace(F.regexp_extract(declare, r"(?is)\bCURSOR\s+(?:WITH\s+HOLD\s+)?FOR\s+(.+)", 1), r"(?i)^\s*EXEC\s+SQL\s+|[\s;]+$", "")
    return F.when(into_clause.isNull(), query).otherwise(sqltree.as_column(lambda t, clause: sqltree.with_into(t, clause or ""), "string", query, into_clause))


def declared_scope(variables: DataFrame, sections: DataFrame, functions: DataFrame) -> DataFrame:
    """Variables (file_id, line_start, raw) with their scope: declare_section, static(_local), local or global, in that order.

    One window over each file's lines: the last section and function that began
    at or before a line say whether the line is inside (neither nests).
    """
    spans = sections.select("file_id", "line_start", F.col("line_end").alias("_section"), F.lit(None).cast("long").alias("_function")).unionByName(functions.select("file_id", "line_start", F.lit(None).cast("long").alias("_section"), F.col("line_end").alias("_function")))
    both = variables.withColumn("_is", F.lit(True)).unionByName(spans.withColumn("_is", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("file_id").orderBy("line_start", "_is").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda c: F.coalesce(F.last(c, True).over(before) >= F.col("line_start"), F.lit(False))
    static = F.regexp_like("raw", F.lit(r"(?i)^\s*static\b"))
    placed = both.withColumns({"_in_section": inside("_section"), "_in_function": inside("_function")}).where("_is")
    scope = F.when(F.col("_in_section"), "declare_section").when(static & F.col("_in_function"), "static_local").when(static, "static").when(F.col("_in_function"), "local").otherwise("global")
    return placed.withColumn("scope", scope).select(*variables.columns, "scope")


def statement_ids(stmts: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """sql_id by place in the file, and a name by kind with its own counter from 0.

    ``counters`` (file_id, sql_type, next; a null sql_type: of sql_id) say where counting goes on, as ``next_ids`` gives them.
    """
    by_file, by_kind = Window.partitionBy("file_id").orderBy("line_start"), Window.partitionBy("file_id", "sql_type").orderBy("line_start")
    numbered = stmts.withColumns({"_id": F.row_number().over(by_file), "_name": F.row_number().over(by_kind) - 1})
    if counters is not None:
        ids = counters.where("sql_type is null").select("file_id", (F.col("next") - 1).alias("_i"))
        names = counters.where("sql_type is not null").select("file_id", "sql_type", F.col("next").alias("_n"))
        numbered = numbered.join(ids, "file_id", "left").join(names, ["file_id", "sql_type"], "left")
        numbered = numbered.withColumns({"_id": F.col("_id") + F.coalesce("_i", F.lit(0)), "_name": F.col("_name") + F.coalesce("_n", F.lit(0))}).drop("_i", "_n")
    return numbered.withColumn("sql_id", F.format_string("sql_%03d", F.col("_id").cast("long"))).withColumn("sql_name", F.concat("sql_type", F.lit("_"), F.col("_name").cast("string"))).drop("_id", "_name")


def next_ids(stmts: DataFrame) -> DataFrame:
    """file_id, sql_type, next: the numbers that come next, by kind, and for sql_id (null kind); without using them up."""
    kinds = stmts.groupBy("file_id", "sql_type").agg(F.count(F.lit(1)).alias("next"))
    return kinds.unionByName(stmts.groupBy("file_id").agg((F.count(F.lit(1)) + 1).alias("next")).withColumn("sql_type", F.lit(None).cast("string")))


def built_sql(calls: DataFrame) -> DataFrame:
    """file_id, function, target, sql_text, confidence: string calls folded in line order.

    ``calls``: file_id, function, line_start, name (strcpy, strcat, sprintf and
    their n-forms), target, value. A copy starts the text anew, a concatenation
    adds to it; what is not known is '?'.
    """
    ops = F.array_sort(F.collect_list(F.struct("line_start", "name", F.coalesce("value", F.lit("?")).alias("value"))))
    text = F.aggregate(ops, F.lit(""), lambda acc, o: F.when(o["name"].isin("strcat", "strncat"), F.concat(acc, o["value"])).otherwise(o["value"]))
    unknown = F.size(F.filter(ops, lambda o: F.contains(o["value"], F.lit("?"))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - 0.05 * F.size(ops) - 0.1 * unknown))
    return calls.groupBy("file_id", "function", "target").agg(text.alias("sql_text"), F.round(score, 4).alias("confidence"))


def docstrings(functions: DataFrame, comments: DataFrame, gap: int = 2) -> DataFrame:
    """Functions with the comments that end at most ``gap`` lines above, chained upwards: islands by running sum."""
    w = Window.partitionBy("file_id").orderBy("line_start")
    islands = comments.withColumn("_new", F.when(F.col("line_start") - F.lag("line_end").over(w) <= gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    texts = islands.groupBy("file_id", "_island").agg(F.max("line_end").alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "raw"))), lambda s: s["raw"]), "\n").alias("_text"))
    ends = texts.select("file_id", "_at", F.struct("_at", "_text").alias("_doc"))
    row = F.struct(*(F.col(f"`{c}`") for c in functions.columns)).alias("_row")
    both = functions.select("file_id", F.col("line_start").cast("long").alias("_at"), row).unionByName(ends, allowMissingColumns=True)
    above = Window.partitionBy("file_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)  # on lines before
    near = both.withColumn("_doc", F.last("_doc", True).over(above)).where("_row is not null")
    docstring = F.when(F.col("_at") - F.col("_doc._at") <= gap, F.col("_doc._text"))
    return near.select(*(F.col("_row").getField(c).alias(c) for c in functions.columns), docstring.alias("docstring"))


def macro_sizes(variables: DataFrame, macros: DataFrame) -> DataFrame:
    """Array sizes with macro names replaced by their values, others as they stand; macros come by file as a map."""
    table = macros.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("_m"))
    return variables.join(table, "file_id", "left").withColumn("resolved_array_sizes", F.transform("array_sizes", lambda x: F.coalesce(F.try_element_at(F.col("_m"), x), x))).drop("_m")


def uncovered(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs of lines (file_id, line_start, line_end) that no span covers: gaps between running maxima."""
    w = Window.partitionBy("file_id").orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("file_id").agg((F.max("line_no") + 1).alias("line_start")).withColumn("line_end", F.col("line_start"))
    gaps = spans.select("file_id", "line_start", "line_end").unionByName(ends).withColumn("_from", F.coalesce(F.max("line_end").over(w), F.lit(0)) + 1)
    return gaps.where("_from < line_start").select("file_id", F.col("_from").alias("line_start"), (F.col("line_start") - 1).alias("line_end"))
