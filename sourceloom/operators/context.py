"""Nested contexts of functions, searches of notes, and summaries of uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rewrite import camel, xml_escape

# fixed values: names of the field that counts an array's entries, best first
COUNT_NAMES = ("{}_count", "{}_cnt", "{}Count", "{}Cnt")


def last_wins_cursors(stmts: DataFrame) -> DataFrame:
    """A row for each cursor name, in any order of lines: the last DECLARE, OPEN and CLOSE, all fetches."""
    named = stmts.withColumn("name", F.lower(F.regexp_extract("sql_text", r"(?i)\b(?:DECLARE|OPEN|FETCH|CLOSE)\s+(\w+)", 1))).where("name <> ''")
    last = lambda kind: F.max(F.when(F.col("sql_type") == kind, F.col("line_start")))
    out = named.groupBy("file_id", "name").agg(last("declare_cursor").alias("declare_line"), last("open_cursor").alias("open_line"), last("close_cursor").alias("close_line"), F.count(F.when(F.col("sql_type") == "fetch_into", 1)).alias("fetches"))
    return out.where("declare_line is not null").withColumn("is_loop", F.col("fetches") > 1)


def count_fields(fields: DataFrame, manual: dict[str, str] | None = None) -> DataFrame:
    """Each array field with the sibling that counts it: a given one, else the first known name that its struct has."""
    names = fields.groupBy("struct_name").agg(F.collect_set("name").alias("_all"))
    given = F.create_map(*(F.lit(x) for kv in (manual or {"": ""}).items() for x in kv))
    found = [F.when(F.array_contains("_all", F.concat(F.lit(p.split("{}")[0]), F.col("name"), F.lit(p.split("{}")[1]))), F.concat(F.col("name"), F.lit(p.split("{}")[1]))) for p in COUNT_NAMES]
    return fields.where("array_size is not null").join(names, "struct_name").withColumn("count_field", F.coalesce(F.try_element_at(given, F.col("name")), *found)).drop("_all")


def java_names(variables: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """java_name with all source names that become it, sorted."""
    longest = "|".join(sorted(prefixes, key=len, reverse=True))
    return variables.groupBy(camel(F.regexp_replace("name", f"^(?:{longest})(?=.)", "")).alias("java_name")).agg(F.array_sort(F.collect_set("name")).alias("source_names"))


def chain_edges(assignments: DataFrame) -> DataFrame:
    """(target, source) of neighbours in ``a = b = c``."""
    parts = F.transform(F.split("statement", "="), lambda x: F.trim(x))
    n = F.size(parts)
    return assignments.where(n > 1).select("file_id", F.explode(F.zip_with(F.slice(parts, F.lit(1), n - 1), F.slice(parts, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("target"), b.alias("source")))).alias("e")).select("file_id", "e.*")


def field_accesses(code: DataFrame) -> DataFrame:
    """struct, field, access (write before a single =, else read), is_pointer of each member access in ``content``."""
    hits = F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*(?:->|\.)[A-Za-z_]\w*\s*(?:=(?!=))?)"), F.lit(1))
    x = F.col("x")
    return code.select("file_id", F.explode(hits).alias("x")).select("file_id", F.regexp_extract(x, r"^(\w+)", 1).alias("struct"), F.regexp_extract(x, r"(?:->|\.)(\w+)", 1).alias("field"), F.when(F.regexp_like(x, F.lit("=$")), "write").otherwise("read").alias("access"), F.contains(x, F.lit("->")).alias("is_pointer"))


def use_summary(uses: DataFrame) -> DataFrame:
    """Lines of definitions, reads and writes of each variable, sorted."""
    lines = lambda k: F.array_sort(F.collect_set(F.when(F.col("use_type") == k, F.col("line")))).alias(k)
    return uses.groupBy("variable_name").agg(lines("define"), lines("read"), lines("write"))


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets of each source, and sources of each target, sorted."""
    return (
        edges.groupBy("source_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets")),
        edges.groupBy("target_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources")),
    )


def latest_macros(macros: DataFrame, numeric: bool = False) -> DataFrame:
    """name, value: the last file's value of each macro; only numbers, if asked for."""
    kept = macros.where(F.regexp_like("value", F.lit(r"^-?(?:0[xX][0-9A-Fa-f]+|\d+)$"))) if numeric else macros
    return kept.groupBy("name").agg(F.max_by("value", F.struct("file_ord", "value")).alias("value"))


def function_contexts(functions: DataFrame, variables: DataFrame, stmts: DataFrame, calls: DataFrame) -> DataFrame:
    """One nested row for each function: variables, statements and own calls, each sorted."""
    nest = lambda df, name, *cols: df.groupBy("file_id", "function").agg(F.array_sort(F.collect_set(F.struct(*cols))).alias(name))
    out = functions.select("file_id", F.col("name").alias("function"), "line_start", "line_end")
    for part in (nest(variables, "variables", "name", "data_type"), nest(stmts, "statements", "line_start", "sql_type"), nest(calls, "calls", "name")):
        out = out.join(part, ["file_id", "function"], "left")
    return out.withColumn("summary", F.format_string("%s: %d variables, %d statements, %d calls", "function", *(F.coalesce(F.size(c), F.lit(0)) for c in ("variables", "statements", "calls"))))


def prompt_text(contexts: DataFrame, form: str = "markdown", most: int = 20) -> DataFrame:
    """file_id, function and a text of each context: ``markdown``, ``compact`` or ``xml``; the latter two show ``most`` variables."""
    none = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as array<struct<{kind}>>)"))
    stmts, held, calls = none("statements", "line_start: bigint, sql_type: string"), F.slice(none("variables", "name: string, data_type: string"), 1, most), none("calls", "name: string")
    lines = lambda c, one, sep="\n": F.array_join(F.transform(c, one), sep)
    if form == "markdown":
        sql = lines(stmts, lambda s: F.format_string("- %d %s", s["line_start"], s["sql_type"]))
        text = F.concat_ws("\n", F.concat(F.lit("## "), "function"), "summary", sql)
    elif form == "compact":
        part = lambda name, c, one, sep: F.when(F.size(c) > 0, F.concat(F.lit(name), lines(c, one, sep)))
        text = F.concat_ws(
            "\n",
            F.format_string("[FUNC]%s %d-%d", "function", "line_start", "line_end"),
            part("[VARS]", held, lambda v: F.concat_ws(" ", v["data_type"], v["name"]), ";"),
            F.when(F.size(stmts) > 0, lines(stmts, lambda s: F.format_string("[SQL:%s]%d", s["sql_type"], s["line_start"]))),
            part("[CALLS]", calls, lambda c: c["name"], ","),
        )
    elif form == "xml":
        esc = lambda c: F.replace(xml_escape(F.coalesce(c, F.lit(""))), F.lit('"'), F.lit("&quot;"))
        group = lambda name, c, one: F.when(F.size(c) > 0, F.concat(F.lit(f"  <{name}>\n"), lines(c, one), F.lit(f"\n  </{name}>")))
        text = F.concat_ws(
            "\n",
            F.format_string('<function name="%s" from="%d" to="%d">', esc(F.col("function")), "line_start", "line_end"),
            group("variables", held, lambda v: F.format_string('    <variable type="%s" name="%s"/>', esc(v["data_type"]), esc(v["name"]))),
            group("statements", stmts, lambda s: F.format_string('    <statement line="%d" type="%s"/>', s["line_start"], s["sql_type"])),
            group("calls", calls, lambda c: F.format_string('    <call name="%s"/>', esc(c["name"]))),
            F.lit("</function>"),
        )
    else:
        raise ValueError(form)
    return contexts.select("file_id", "function", text.alias("text"))


def searched(notes: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The notes whose words meet the query's, by the share of the query's words that they hold; ``most`` of them."""
    words = sorted(set(query.lower().split()))
    have = F.array_distinct(F.split(F.lower("content"), r"\s+"))
    score = F.size(F.array_intersect(have, F.array(*map(F.lit, words)))) / F.lit(max(len(words), 1))
    return notes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "entry_id").limit(most)


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def episode_stats(episodes: DataFrame, *by: str) -> DataFrame:
    """n, successes, success_rate, average steps and score of episodes (success, steps, score), by some columns or of all."""
    won = F.count_if("success")
    return episodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), won.alias("successes"), (won / F.count(F.lit(1))).alias("success_rate"), F.avg("steps").alias("avg_steps"), F.avg("score").alias("avg_score"))


def in_order(elements: DataFrame) -> DataFrame:
    """Elements with ``position``, from 1 in each file: by first line, then in the order in which they were found (seq)."""
    return elements.withColumn("position", F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("line_start").asc_nulls_last(), "seq")))


def verdicts(results: DataFrame) -> DataFrame:
    """stage, n, failed, passed: a stage passes if nothing in it failed."""
    return results.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "fail", 1)).alias("failed")).withColumn("passed", F.col("failed") == 0)


def exported(items: DataFrame, statuses: DataFrame, analyses: DataFrame, only: str | None = None) -> DataFrame:
    """Items with status and analysis by index; those of one status, if asked for."""
    out = items.join(statuses, "idx", "left").join(analyses, "idx", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return out.where(F.col("status") == only) if only else out


def import_order(name: Column) -> Column:
    """java., javax., others; then by name: a struct to sort by."""
    return F.struct(F.when(F.startswith(name, F.lit("java.")), 0).when(F.startswith(name, F.lit("javax.")), 1).otherwise(2).alias("group"), name.alias("name"))


def latest_methods(methods: DataFrame) -> DataFrame:
    """Of methods with one name in a class, the last; others in their order."""
    w = Window.partitionBy("class_id", "name").orderBy(F.desc("ord"))
    return methods.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
