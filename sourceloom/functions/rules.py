"""Statement classification by ordered rules, compiled into one CASE expression each.

A rule is a row (name, priority, pattern). Rules apply by falling priority, in
order among equals, and the first pattern found decides; nothing found is
``unknown``. As a CASE over literal patterns the whole ladder stays in generated
code and needs no join. ``classify_by_table`` takes rules from a table instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    pattern: str


# fixed values: statement kinds, their priorities and patterns
TYPE_RULES = [
    Rule("include", 100, r"EXEC\s+SQL\s+INCLUDE\s+\w+\s*;"),
    Rule("declare_section_begin", 95, r"EXEC\s+SQL\s+BEGIN\s+DECLARE\s+SECTION"),
    Rule("declare_section_end", 95, r"EXEC\s+SQL\s+END\s+DECLARE\s+SECTION"),
    Rule("declare_cursor", 90, r"EXEC\s+SQL\s+DECLARE\s+\w+\s+CURSOR\s+FOR"),
    Rule("fetch_into", 85, r"EXEC\s+SQL\s+FETCH\s+[\s\S]*?INTO"),
    Rule("open_cursor", 80, r"EXEC\s+SQL\s+OPEN\s+\w+"),
    Rule("close_cursor", 80, r"EXEC\s+SQL\s+CLOSE\s+\w+"),
    Rule("whenever", 75, r"EXEC\s+SQL\s+WHENEVER"),
    Rule("prepare", 70, r"EXEC\s+SQL\s+PREPARE"),
    Rule("execute", 70, r"EXEC\s+SQL\s+EXECUTE"),
    Rule("connect", 65, r"EXEC\s+SQL\s+CONNECT"),
    Rule("disconnect", 65, r"EXEC\s+SQL\s+DISCONNECT"),
    Rule("commit", 60, r"EXEC\s+SQL\s+COMMIT"),
    Rule("rollback", 60, r"EXEC\s+SQL\s+ROLLBACK"),
    Rule("select", 50, r"EXEC\s+SQL\s+(?:/\*.*?\*/\s*)?SELECT"),
    Rule("insert", 50, r"EXEC\s+SQL\s+INSERT"),
    Rule("update", 50, r"EXEC\s+SQL\s+UPDATE"),
    Rule("delete", 50, r"EXEC\s+SQL\s+DELETE"),
]
# fixed values: isolation and row-limit clauses of one dialect, above plain selects
DB2_RULES = [
    Rule("select_with_ur", 55, r"EXEC\s+SQL\s+SELECT[\s\S]*?WITH\s+UR"),
    Rule("select_with_cs", 55, r"EXEC\s+SQL\s+SELECT[\s\S]*?WITH\s+CS"),
    Rule("select_with_rs", 55, r"EXEC\s+SQL\s+SELECT[\s\S]*?WITH\s+RS"),
    Rule("select_with_rr", 55, r"EXEC\s+SQL\s+SELECT[\s\S]*?WITH\s+RR"),
    Rule("select_fetch_first", 55, r"EXEC\s+SQL\s+SELECT[\s\S]*?FETCH\s+FIRST\s+\d+\s+ROWS?\s+ONLY"),
    Rule("select_optimize_for", 55, r"EXEC\s+SQL\s+SELECT[\s\S]*?OPTIMIZE\s+FOR\s+\d+\s+ROWS?"),
]
# fixed values: first words that name a statement's kind
FIRST_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DECLARE", "OPEN", "FETCH", "CLOSE", "COMMIT", "ROLLBACK", "CONNECT", "PREPARE", "EXECUTE", "INCLUDE", "WHENEVER", "CREATE", "DROP", "ALTER", "TRUNCATE", "MERGE", "CALL", "LOCK", "SAVEPOINT", "BEGIN")
# fixed values: display names
DISPLAY = {"fetch_into": "FETCH", "declare_cursor": "DECLARE", "open_cursor": "OPEN", "close_cursor": "CLOSE", "declare_section_begin": "BEGIN", "declare_section_end": "END"}
# fixed values: statement kind to mapper tag, for the converter and for the generator (they differ on unknown kinds)
CONVERTER_TAGS, GENERATOR_TAGS = ({"select": "select", "declare_cursor": "select", "insert": "insert", "update": "update", "delete": "delete"}, "select"), ({"select": "select", "insert": "insert", "update": "update", "delete": "delete"}, "update")
# fixed values: header kinds' marks
HEADER_MARKS = {"has_stp": r"_stp\s*\[\s*\]", "has_struct": r"typedef\s+struct", "has_macro": r"(?m)^\s*#define\s+\w+\s+\S", "has_func": r"(?m)^\s*(?:extern\s+)?\w+[\s*]+\w+\s*\([^;{]*\)\s*;"}


# fixed values: headers of the C library
SYSTEM_HEADERS = ("stdio.h", "stdlib.h", "string.h", "math.h", "time.h", "ctype.h", "errno.h", "signal.h", "stdarg.h", "stddef.h", "limits.h", "float.h")


class RuleSet:
    """Rules that can be added to, listed, cleared and compiled."""

    def __init__(self, rules: list[Rule] | None = None) -> None:
        self.rules = list(TYPE_RULES if rules is None else rules)

    def register(self, *rules: Rule) -> "RuleSet":
        self.rules.extend(rules)
        return self

    def clear(self) -> "RuleSet":
        self.rules.clear()
        return self

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: -r.priority)

    def compile(self, text: Column) -> Column:
        out = F.lit("unknown")
        for rule in reversed(self.ordered()):
            out = F.when(F.regexp_like(text, F.lit("(?i)" + rule.pattern)), rule.name).otherwise(out)
        return out

    def check_case(self, text: str) -> str:
        """The same ladder for the checking engine."""
        arms = " ".join(f"WHEN regexp_matches({text}, '(?i){r.pattern}') THEN '{r.name}'" for r in self.ordered())
        return f"CASE {arms} ELSE 'unknown' END"


def sql_type(text: Column) -> Column:
    return RuleSet().compile(text)


def db2_metadata(text: Column) -> Column:
    """isolation_level, fetch_first, optimize_for and dbms as a map without absent entries."""
    pick = lambda pattern: F.nullif(F.regexp_extract(text, "(?i)" + pattern, 1), F.lit(""))
    found = F.create_map(F.lit("isolation_level"), F.upper(pick(r"WITH\s+(UR|CS|RS|RR)")), F.lit("fetch_first"), pick(r"FETCH\s+FIRST\s+(\d+)\s+ROWS?"), F.lit("optimize_for"), pick(r"OPTIMIZE\s+FOR\s+(\d+)\s+ROWS?"))
    kept = F.map_filter(found, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.map_concat(kept, F.create_map(F.lit("dbms"), F.lit("db2")))).otherwise(kept)


def first_word_type(text: Column) -> Column:
    """The kind by first keyword, comments, prefix and array clause removed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/|--[^\n]*", " "), r"(?i)EXEC\s+SQL|\bFOR\s+:?\w+\s+(?=INSERT|UPDATE|DELETE)", " ")
    word = F.upper(F.regexp_extract(bare, r"^\s*(\w+)", 1))
    return F.when(word.isin(*FIRST_WORDS), word).otherwise("UNKNOWN")


def display_type(kind: Column) -> Column:
    out = F.upper(kind)
    for name, shown in DISPLAY.items():
        out = F.when(kind == name, shown).otherwise(out)
    return out


def tag(kind: Column, tags: tuple[dict[str, str], str] = CONVERTER_TAGS) -> Column:
    out = F.lit(tags[1])
    for name, shown in tags[0].items():
        out = F.when(kind == name, shown).otherwise(out)
    return out


#: rules of one CASE
CASE_RULES = 5_000


def classify_by_table(df: DataFrame, rules: DataFrame, text: str = "sql_text") -> DataFrame:
    """Rules from a table (name, priority, ord, pattern): the first by priority wins; adds ``rule``.

    The rules become CASE expressions over the text, some thousands in each, so rows
    are neither joined nor told apart by a key. For plain words see ``automaton.routed``.
    """
    found = rules.orderBy(F.desc("priority"), "ord", "name").collect()
    out = df.withColumn("rule", F.lit(None).cast("string"))
    for k in range(0, len(found), CASE_RULES):
        arms = [F.when(F.regexp_like(text, F.lit(r.pattern)), r["name"]) for r in found[k : k + CASE_RULES]]
        out = out.withColumn("rule", F.coalesce("rule", *arms))
    return out.withColumn("rule", F.coalesce("rule", F.lit("unknown")))


def strict_type(text: Column, kinds: RuleSet | None = None) -> Column:
    """The kind by ordered names; null where no rule knows the statement, whose block a caller may drop."""
    return F.nullif((kinds or RuleSet()).compile(text), F.lit("unknown"))


def kind_by_substring(text: Column) -> Column:
    """select, declare_cursor, insert, update, delete, fetch_into or unknown, by what a text begins with or holds."""
    up = F.upper(F.trim(text))
    is_ = lambda w: F.startswith(up, F.lit(w)) | F.contains(up, F.lit(f"EXEC SQL {w}"))
    cursor = F.contains(up, F.lit("DECLARE")) & F.contains(up, F.lit("CURSOR"))
    return F.when(is_("SELECT"), "select").when(cursor, "declare_cursor").when(is_("INSERT"), "insert").when(is_("UPDATE"), "update").when(is_("DELETE"), "delete").when(is_("FETCH"), "fetch_into").otherwise("unknown")


# fixed values: types of C, and kinds that change a schema
PRIMITIVES = ("int", "char", "long", "short", "float", "double", "void", "unsigned", "signed", "varchar")
DDL = ("create", "alter", "drop", "truncate")


def is_primitive(type_name: Column) -> Column:
    return F.lower(F.trim(type_name)).isin(*PRIMITIVES)


def is_custom_struct(type_name: Column) -> Column:
    return ~is_primitive(type_name)


def is_ddl(kind: Column) -> Column:
    return F.lower(kind).isin(*DDL)


def typed_headers(headers: DataFrame, text: str = "content", name: str = "file_id") -> DataFrame:
    """header_type, n, files: all headers by type."""
    return headers.select(header_type(F.col(text), F.col(name).cast("string")).alias("header_type"), name).groupBy("header_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(name)).alias("files"))


def header_type(text: Column, path: Column | None = None) -> Column:
    """stp, mixed, struct, macro, function or unknown, by the marks that a header has; system, by its name, if a path is given."""
    if path is not None:
        return F.when(F.regexp_extract(path, r"([^/]*)$", 1).isin(*SYSTEM_HEADERS), "system").otherwise(header_type(text))
    marks = {k: F.regexp_like(text, F.lit(p)) for k, p in HEADER_MARKS.items()}
    several = sum(m.cast("int") for k, m in marks.items() if k != "has_stp") >= 2
    return F.when(marks["has_stp"], "stp").when(several, "mixed").when(marks["has_struct"], "struct").when(marks["has_macro"], "macro").when(marks["has_func"], "function").otherwise("unknown")


def keyword_counts(df: DataFrame, text: str, words: tuple[str, ...] = FIRST_WORDS) -> DataFrame:
    """(keyword, n) over all rows, comments left out, in long form."""
    bare = F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/|//[^\n]*|--[^\n]*", " ")
    found = F.regexp_extract_all(bare, F.lit(rf"(?i)EXEC\s+SQL\s+({'|'.join(words)})\b"), F.lit(1))
    return df.select(F.explode(found).alias("w")).groupBy(F.upper("w").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


def route(text: Column, table: list[tuple[str, list[str]]], default: str) -> Column:
    """The first target, in order, one of whose keywords the text contains."""
    out = F.lit(default)
    for target, words in reversed(table):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w.lower()))
        out = F.when(hit, target).otherwise(out)
    return out


def gate(text: Column, required: list[str], forbidden: list[str]) -> Column:
    """VERIFIED, UNVERIFIED (something required is missing) or HALLUCINATION (something forbidden is there)."""
    missing, bad = F.lit(False), F.lit(False)
    for w in required:
        missing = missing | ~F.contains(text, F.lit(w))
    for p in forbidden:
        bad = bad | F.regexp_like(text, F.lit(p))
    return F.when(bad, "HALLUCINATION").when(missing, "UNVERIFIED").otherwise("VERIFIED")


def grep(df: DataFrame, text: str, pattern: str, path: str) -> DataFrame:
    """(path, line_no, line) of matching lines."""
    return df.select(path, F.posexplode(F.split(text, "\n")).alias("k", "line")).where(F.regexp_like("line", F.lit(pattern))).select(path, (F.col("k") + 1).cast("long").alias("line_no"), "line")
