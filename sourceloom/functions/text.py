"""Smaller text operators: quoted splits, masks, markers, edits, line slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hostvars import name_of
from .rewrite import camel, split_columns


def split_arguments(c: Column) -> Column:
    """A list split at commas outside parentheses and quotes."""
    parts = F.regexp_extract_all(c, F.lit(r"""((?:[^,()'"]|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|\((?:[^()]|\([^()]*\))*\))+)"""), F.lit(1))
    return F.transform(parts, lambda x: F.trim(x))


def in_literal(before: Column) -> Column:
    """Whether a place is inside a string, from an odd count of quotes before it."""
    return F.length(F.regexp_replace(before, "[^']", "")) % 2 == 1


def protected_times(c: Column) -> Column:
    """Colons of format models and time literals inside strings, as a sign that no variable has; see ``restored_times``."""
    return F.regexp_replace(c, r"(?<=[0-9A-Za-z]{2}):(?=[0-9A-Za-z]{2})(?=[^']*'(?:[^']*'[^']*')*[^']*$)", "\u0001")


def restored_times(c: Column) -> Column:
    return F.replace(c, F.lit("\u0001"), F.lit(":"))


def returning_aliases(c: Column) -> Column:
    """``RETURNING a, b INTO :x, :y`` with each column aliased by its variable."""
    columns = split_columns(F.regexp_extract(c, r"(?is)\bRETURNING\s+(.*?)\s+INTO\b", 1))
    targets = F.regexp_extract_all(F.regexp_extract(c, r"(?is)\bRETURNING\s+.*?\s+INTO\s+([^;]*)", 1), F.lit(r":\w+"), F.lit(0))
    listed = F.array_join(F.zip_with(columns, targets, lambda col, v: F.when(v.isNull(), col).otherwise(F.concat(col, F.lit(" AS "), camel(name_of(v))))), ", ")
    has = F.regexp_like(c, F.lit(r"(?is)\bRETURNING\s+.*?\s+INTO\b"))
    return F.when(has, F.concat(F.regexp_extract(c, r"(?is)^(.*?\bRETURNING\s+)", 1), listed)).otherwise(c)


def shortened(c: Column, most: int, mark: str = " ...") -> Column:
    """The first ``most`` characters of a text that has more, with a mark."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def first_of(listed: Column, most: int) -> Column:
    """The first ``most`` entries of a list."""
    return F.slice(listed, 1, most)


def marker(sql_id: Column, kind: Column) -> Column:
    return F.format_string("/* @sql %s %s */", sql_id, kind)


def spliced(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files with each block (start, end, marker) replaced by its marker, told by offsets."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "marker")))
    held = blocks.groupBy("file_id").agg(ordered.alias("_b"))
    kept = F.expr("transform(_b, (b, i) -> concat(substring(content, cast(if(i = 0, 0, _b[i - 1].end) + 1 as int), cast(b.start - if(i = 0, 0, _b[i - 1].end) as int)), b.marker))")
    new = F.when(F.col("_b").isNull(), F.col("content")).otherwise(F.concat(F.array_join(kept, ""), F.expr("substring(content, cast(element_at(_b, -1).end + 1 as int))")))
    return files.join(held, "file_id", "left").withColumn("content", new).drop("_b")


def line_slice(files: DataFrame, first: int, last: int) -> DataFrame:
    """(file_id, line_no, line) of the lines from first to last."""
    return files.select("file_id", F.posexplode(F.slice(F.split("content", "\n"), first, last - first + 1)).alias("k", "line")).select("file_id", (F.col("k") + first).cast("long").alias("line_no"), "line")


def macro_calls(c: Column, name: str = "BAMCALL") -> Column:
    """Arguments of each call of a project macro."""
    return F.regexp_extract_all(c, F.lit(rf"\b{name}\s*\((.*?)\)\s*;"), F.lit(1))


def replaced(c: Column, old: str, new: str, regex: bool = False) -> Column:
    return F.regexp_replace(c, old, new) if regex else F.replace(c, F.lit(old), F.lit(new))
