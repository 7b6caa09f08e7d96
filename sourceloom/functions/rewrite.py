"""Rewrites of SQL text as expressions: normalising, mapper text, names, dialects, paging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sqltree
from .hostvars import name_of

Rewrite = Callable[[Column], Column]


def _sub(pattern: str, new: str) -> Rewrite:
    return lambda c: F.regexp_replace(c, pattern, new)


#: literals, quoted names and comments, each whole, and what lies between
_PIECE = r"""(?s)'[^']*'?|"[^"]*"?|--[^\n]*|/\*.*?(?:\*/|\z)|[^'"/-]+|."""


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space as one space, but for that in literals and quoted names."""
    one = lambda x: F.regexp_replace(x, r"\s+", " ")
    kept = F.array_join(F.transform(_pieces(c), lambda x: F.when(F.regexp_like(x, F.lit("^['\"]")), x).otherwise(one(x))), "")
    return F.trim(F.when(F.regexp_like(c, F.lit("['\"]")), kept).otherwise(one(c)))


def bare(c: Column) -> Column:
    """The text without its literals, quoted names and comments, to look for words in."""
    return F.array_join(F.filter(_pieces(c), lambda x: ~F.regexp_like(x, F.lit(r"""^(?:['"]|--|/\*)"""))), " ")


def without_comments(c: Column, hints: bool = True) -> Column:
    """Comments removed, hints kept (or not); what looks like a comment in a literal stays."""
    return sqltree.as_column(lambda t: sqltree.without_comments(t, hints), "string", c)


def without_into(c: Column, compat: bool = False) -> Column:
    """INTO lists up to the FROM of their own level removed; ``compat`` leaves lists in which an f stands, as older rules did."""
    return F.regexp_replace(c, r"(?i)\bINTO\s+[^Ff]+(?=\bFROM\b)", "") if compat else sqltree.as_column(sqltree.without_into, "string", c)


def normalized(c: Column) -> Column:
    """Prefix, array clause, INTO list and final semicolon removed, white space squeezed."""
    c = F.regexp_replace(c, r"(?i)^\s*EXEC\s+SQL\s+", "")
    c = F.regexp_replace(c, r"(?i)^FOR\s+:?\w+\s+", "")
    c = F.when(F.regexp_like(c, F.lit(r"(?i)^\s*SELECT")), without_into(c)).when(F.regexp_like(c, F.lit(r"(?i)^\s*FETCH")), F.regexp_replace(c, r"(?is)\bINTO\s+.*$", "")).otherwise(c)
    return squeeze(F.regexp_replace(c, r";\s*$", ""))


def _title(part: Column) -> Column:
    """A capital after the start and after digits, the rest in lower case."""
    pieces = F.regexp_extract_all(part, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def camel(c: Column, keep_first: bool = False, title: bool = True) -> Column:
    """snake_case to camelCase; variants keep the first part or don't capitalise after digits."""
    parts = F.split(c, "_")
    rest = F.transform(F.slice(parts, 2, 1 << 20), _title if title else lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20))))
    return F.concat(parts[0] if keep_first else F.lower(parts[0]), F.array_join(rest, ""))


def pascal(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?<=[a-z0-9])([A-Z])", "_$1"))


def class_name(struct: Column) -> Column:
    return pascal(camel(F.regexp_replace(struct, "_t$", "")))


def host_name(variable: Column, keep: bool = False, first_upper: bool = False) -> Column:
    """The name for a host variable (colon, indicator, subscript and member go): camelCase, or as it is; with a capital if asked for."""
    bare = F.regexp_extract(variable, r"^:?(\w+)", 1)
    name = bare if keep else camel(bare)
    return pascal(name) if first_upper else name


def host_names(variables: Column, keep: bool = False, first_upper: bool = False) -> Column:
    """The names for a list of host variables, each once, in order."""
    return F.array_distinct(F.transform(variables, lambda v: host_name(v, keep, first_upper)))


def safe_id(c: Column, most: int = 50) -> Column:
    """A text as an identifier of at most ``most`` characters; one that is cut ends with a hash of the whole, so that two don't meet."""
    plain = F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    plain = F.when(F.regexp_like(plain, F.lit("^[0-9]")), F.concat(F.lit("_"), plain)).otherwise(plain)
    mark = F.lower(F.lpad(F.hex(F.xxhash64(c).bitwiseAND(0xFFFFFFFF)), 8, "0"))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 9), F.lit("_"), mark))


def stripped_name(c: Column, prefixes: tuple[str, ...]) -> Column:
    """The first (longest) of the prefixes removed, then camelCase."""
    longest = "|".join(sorted(prefixes, key=len, reverse=True))
    return camel(F.regexp_replace(c, f"^(?:{longest})(?=.)", ""))


def parameters(c: Column, listed: Column, by_camel: bool = False) -> Column:
    """Variables as ``#{name}``, but for what stands in literals; indicators and indexes go, members use an underscore."""
    c = sqltree.as_column(sqltree.parameters, "string", c)
    if not by_camel:
        return c
    return F.aggregate(F.array_distinct(listed), c, lambda acc, v: F.replace(acc, F.concat(F.lit("#{"), name_of(v), F.lit("}")), F.concat(F.lit("#{"), camel(name_of(v)), F.lit("}"))))


def split_columns(c: Column) -> Column:
    """A list split at commas outside parentheses and literals."""
    return sqltree.as_column(sqltree.split_list, "array<string>", c)


def select_columns(c: Column) -> Column:
    """The columns of the first SELECT, up to the INTO or FROM of its own level."""
    return sqltree.as_column(sqltree.columns, "array<string>", c)


def with_aliases(c: Column, out_vars: Column) -> Column:
    """`` AS alias`` after each selected column that has no name, from the output variables in order; the rest of the text stays."""
    return sqltree.as_column(lambda t, names: sqltree.with_aliases(t, names or []), "string", c, F.transform(out_vars, lambda v: camel(name_of(v))))


def mapper_sql(c: Column, kind: Column, out_vars: Column, in_vars: Column) -> Column:
    """The statement as mapper text: prefix off, aliases on, INTO off, variables as parameters, cleaned."""
    c = F.regexp_replace(c, r"(?i)^\s*EXEC\s+SQL\s+", "")
    c = F.when(kind == "select", with_aliases(c, out_vars)).otherwise(c)
    c = F.when(kind == "select", without_into(c)).otherwise(c)
    return F.rtrim(F.regexp_replace(squeeze(parameters(c, in_vars)), r";\s*$", ""))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rendered(template: Column, values: Column) -> Column:
    """``${key}`` replaced from a map."""
    return F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def json_block(c: Column) -> Column:
    """The JSON of a fenced answer, or of the outermost braces."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


@dataclass(frozen=True)
class Step:
    """One rewrite of a pipeline; lower priorities run first."""

    name: str
    priority: int
    rewrite: Rewrite
    applies: Callable[[Column], Column] | None = None
    enabled: bool = True


class Pipeline:
    """Rewrites in order of priority, with the names of those that changed the text."""

    def __init__(self, *steps: Step) -> None:
        self.steps = sorted((s for s in steps if s.enabled), key=lambda s: s.priority)

    def run(self, c: Column) -> Column:
        """struct(sql, applied)"""
        applied = []
        for s in self.steps:
            new = s.rewrite(c)
            new = F.when(s.applies(c), new).otherwise(c) if s.applies else new
            applied.append(F.when(~new.eqNullSafe(c), s.name))
            c = new
        return F.struct(c.alias("sql"), F.array_compact(F.array(*applied)).alias("applied"))


# fixed values: function names of one dialect and of another; arguments keep their order but where a template says so
ORACLE_TO_MYSQL = sqltree.Dialect(
    {
        "NVL": "IFNULL",
        "NVL2": "IF",
        "TO_DATE": "STR_TO_DATE",
        "SUBSTR": "SUBSTRING",
        "INSTR": "LOCATE",
        "ADD_MONTHS": "DATE_ADD({0}, INTERVAL {1} MONTH)",
        "MONTHS_BETWEEN": "TIMESTAMPDIFF(MONTH, {1}, {0})",
        "DECODE": sqltree.case_of_decode,
    },
    {("SYSDATE",): "NOW()", ("SYSTIMESTAMP",): "NOW()"},
    concat="CONCAT",
    looks=False,
)
DB2_TO_MYSQL = sqltree.Dialect(
    {"VALUE": "IFNULL", "POSSTR": "LOCATE"},
    {("CURRENT", "DATE"): "CURDATE()", ("CURRENT", "TIMESTAMP"): "NOW()", ("CURRENT", "TIME"): "CURTIME()", ("FETCH", "FIRST", "#", "ROW|ROWS", "ONLY"): ""},
    looks=False,
)
MYSQL_TO_ORACLE = sqltree.Dialect(
    {"IFNULL": "NVL", "NOW": lambda args: None if args else "SYSDATE", "CURDATE": lambda args: "TRUNC(SYSDATE)", "CURTIME": lambda args: "TO_CHAR(SYSDATE, 'HH24:MI:SS')"},
    {("LIMIT", "#", "OFFSET", "#"): "", ("LIMIT", "#"): ""},
    looks=False,
)
CONCATENATION = sqltree.Dialect({}, concat="CONCAT", looks=False)


def in_dialect(dialect: sqltree.Dialect) -> Rewrite:
    return lambda c: sqltree.as_column(dialect.rewritten if dialect.looks else sqltree.Forms(dialect.of_tokens), "string", c)


def decode_to_case(c: Column) -> Column:
    """Each flat DECODE as CASE, one whose arguments have calls inside stays: the form of older tools (``oracle_to_mysql`` does all)."""
    flat = r"(?i)\bDECODE\s*\(([^()]*)\)"

    def case(whole: Column, inside: Column) -> Column:
        args = F.transform(F.split(inside, ","), lambda x: F.btrim(x, F.lit(" \t\r\n")))
        n = F.size(args)
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 3) / 2).cast("int"), F.lit(0))), lambda k: F.concat(F.lit(" WHEN "), F.get(args, 2 * k + 1), F.lit(" THEN "), F.get(args, 2 * k + 2)))
        tail = F.when(n % 2 == 0, F.concat(F.lit(" ELSE "), F.get(args, n - 1))).otherwise("")
        return F.when(n >= 3, F.concat(F.lit("CASE "), F.get(args, F.lit(0)), F.array_join(pairs, ""), tail, F.lit(" END"))).otherwise(whole)

    new = F.zip_with(F.regexp_extract_all(c, F.lit(flat), F.lit(0)), F.regexp_extract_all(c, F.lit(flat), F.lit(1)), case)
    # text, DECODE, text, ..., DECODE, text
    rewritten = F.array_join(F.zip_with(F.split(c, flat), new, lambda text, one: F.concat(text, F.coalesce(one, F.lit("")))), "")
    return F.when(F.regexp_like(c, F.lit(flat)), rewritten).otherwise(c)


def concat_calls(c: Column) -> Column:
    """``a || b || c`` as one call, whatever its operands and however many."""
    return in_dialect(CONCATENATION)(c)


def oracle_to_mysql(c: Column) -> Column:
    return in_dialect(ORACLE_TO_MYSQL)(c)


DIALECTS: dict[tuple[str, str], Rewrite] = {("oracle", "mysql"): oracle_to_mysql, ("db2", "mysql"): in_dialect(DB2_TO_MYSQL), ("mysql", "oracle"): in_dialect(MYSQL_TO_ORACLE)}


def needs_paging(kind: Column, cursor_based: Column, wanted: Column) -> Column:
    """Whether a statement is to be paged: a select or a declared cursor that is read by cursor, or asks for it."""
    return kind.isin("select", "declare_cursor") & (F.coalesce(cursor_based, F.lit(False)) | F.coalesce(wanted, F.lit(False)))


def first_rows(c: Column, limit: str = "#{limit}") -> Column:
    """The other dialect's form without an offset: the first rows only."""
    closed = F.regexp_replace(c, r"[\s;]+$", "")
    return F.when(F.regexp_like(bare(c), F.lit(r"(?i)\bFETCH\s+FIRST\b")), c).otherwise(F.concat(closed, F.lit(f" FETCH FIRST {limit} ROWS ONLY")))


def default_input(variable: Column) -> Column:
    """An input variable as a parameter in camelCase."""
    return F.concat(F.lit("#{"), camel(name_of(variable)), F.lit("}"))


def default_output(variable: Column) -> Column:
    """An output variable as a result name in camelCase."""
    return camel(name_of(variable))


def paged(c: Column, dbms: str, offset: str = "#{offset}", limit: str = "#{limit}") -> Column:
    """Row limits as a dialect has them, unless the text has its own."""
    has = F.regexp_like(bare(c), F.lit(r"(?i)\bLIMIT\b|\bFETCH\s+(?:FIRST|NEXT)\b|\bROWNUM\b"))
    new = {
        "mysql": F.concat(c, F.lit(f" LIMIT {limit} OFFSET {offset}")),
        "postgresql": F.concat(c, F.lit(f" LIMIT {limit} OFFSET {offset}")),
        "oracle": F.concat(F.lit("SELECT * FROM (SELECT a.*, ROWNUM rn FROM ("), c, F.lit(f") a WHERE ROWNUM <= {offset} + {limit}) WHERE rn > {offset}")),
        "oracle12": F.concat(c, F.lit(f" OFFSET {offset} ROWS FETCH NEXT {limit} ROWS ONLY")),
        "db2": F.concat(F.lit("SELECT * FROM (SELECT a.*, ROW_NUMBER() OVER () AS rn FROM ("), c, F.lit(f") AS a) AS b WHERE rn > {offset} AND rn <= {offset} + {limit}")),
    }[dbms]
    return F.when(has, c).otherwise(new)
