"""Checks of converted SQL, token diffs, samples and reports of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hostvars import variables
from .diffs import diff_summary

# fixed values: keywords that a conversion keeps
KEYWORDS = ("SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "INTO", "VALUES", "SET", "JOIN", "GROUP", "ORDER", "HAVING", "UNION", "AND", "OR", "NOT", "IN", "EXISTS", "BETWEEN", "LIKE", "IS", "NULL")
KEPT = tuple(k for k in KEYWORDS if k != "INTO")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z_]\w*)\b"), F.lit(1)))


def keywords_of(text: Column) -> Column:
    return F.filter(words_of(text), lambda w: w.isin(*KEPT))


def identifiers_of(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"#\{[^}]*\}|:\w+(?:\.\w+)?", " "), r"'(?:[^']|'')*'", " ")
    return F.filter(words_of(bare), lambda w: ~w.isin(*KEYWORDS, "EXEC", "SQL"))


def _check(name: str, status: Column, message: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), status.alias("status"), message.alias("message"))


def conversion_checks(pairs: DataFrame) -> DataFrame:
    """Long form (the pair's columns, check, status, message) of six checks of ``sql`` against ``parsed_sql``."""
    sql, new = F.col("sql"), F.col("parsed_sql")
    n_vars, n_params = F.size(F.array_distinct(variables(sql))), F.size(F.array_distinct(F.regexp_extract_all(new, F.lit(r"#\{(\w+)"), F.lit(1))))
    left, lost = F.size(variables(new)), F.array_except(keywords_of(sql), keywords_of(new))
    names = F.array_except(identifiers_of(sql), identifiers_of(new))
    into = F.regexp_like(sql, F.lit(r"(?i)\bSELECT\b[\s\S]*\bINTO\b"))
    n = F.size(names)
    rows = F.array(
        _check("exec_sql_removed", F.when(F.regexp_like(new, F.lit(r"(?i)EXEC\s+SQL")), "fail").otherwise("pass"), F.lit("")),
        _check("host_vars_converted", F.when(left > 0, "fail").when((n_vars > 0) & (n_params == 0), "warning").otherwise("pass"), F.concat(n_vars.cast("string"), F.lit("/"), n_params.cast("string"))),
        _check("semicolon_removed", F.when(F.regexp_like(new, F.lit(r";\s*$")), "warning").otherwise("pass"), F.lit("")),
        _check("keywords_kept", F.when(F.size(lost) > 0, "warning").otherwise("pass"), F.array_join(F.array_sort(lost), ",")),
        _check("into_removed", F.when(into & F.regexp_like(new, F.lit(r"(?i)\bSELECT\b[\s\S]*\bINTO\b")), "fail").when(into, "pass").otherwise("info"), F.lit("")),
        _check("identifiers_kept", F.when(n > 3, "warning").when(n > 0, "info").otherwise("pass"), F.array_join(F.array_sort(names), ",")),
    )
    return pairs.select(*pairs.columns, F.inline(rows))


def check_totals(checks: DataFrame, by: str = "file") -> DataFrame:
    """Passes, failures and warnings by file and in all (file null)."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    return checks.rollup(by).agg(count("pass"), count("fail"), count("warning"))


def token_diffs(pairs: DataFrame) -> DataFrame:
    """The pairs with similarity and the counts of replaced, deleted and inserted token runs."""
    return diff_summary(pairs)


def static_prechecks(files: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, in_text, extracted, agree: EXEC SQL in the text (comments too) against extracted statements."""
    counted = files.select("file_id", F.regexp_count("content", F.lit(r"(?i)EXEC\s+SQL\b")).cast("long").alias("in_text"))
    have = found.groupBy("file_id").agg(F.count(F.lit(1)).alias("extracted"))
    return counted.join(have, "file_id", "full").select("file_id", F.coalesce("in_text", F.lit(0)).alias("in_text"), F.coalesce("extracted", F.lit(0)).alias("extracted"), (F.coalesce("in_text", F.lit(0)) == F.coalesce("extracted", F.lit(0))).alias("agree"))


def sampled(items: DataFrame, by: str, order: str, text: str, failed: Column, most: int = 10) -> DataFrame:
    """Of each group the two longest items, the first, the last, and the middle one if something failed; ``most`` at most."""
    g = Window.partitionBy(by)
    ranked = items.withColumns(
        {
            "_long": F.row_number().over(g.orderBy(F.length(text).desc(), order)),
            "_at": F.row_number().over(g.orderBy(order)),
            "_n": F.count(F.lit(1)).over(g),
            "_bad": F.max(failed.cast("int")).over(g),
        }
    )
    why = F.when(F.col("_long") <= 2, "longest").when(F.col("_at") == 1, "first").when(F.col("_at") == F.col("_n"), "last").when((F.col("_bad") == 1) & (F.col("_at") == F.floor(F.col("_n") / 2) + 1), "middle")
    chosen = ranked.withColumn("reason", why).where("reason is not null")
    capped = chosen.withColumn("_k", F.row_number().over(g.orderBy(F.expr("case reason when 'longest' then 0 when 'first' then 1 when 'last' then 2 else 3 end"), order))).where(F.col("_k") <= most)
    return capped.drop("_long", "_at", "_n", "_bad", "_k")
