"""Host variables in embedded SQL, as expressions over the statement text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: longest form first: member or element with indicator, then without, then plain
VARIABLE = r"(?<![\w:]):(?!\d)\w+(?:\.\w+|\[[^\]]+\])?(?::\w+)?"
#: the same without lookaround, for engines that lack it; the text must hold no time literals
PLAIN_VARIABLE = r":[A-Za-z_]\w*(?:\.\w+|\[[^\]]+\])?(?::\w+)?"
# fixed values: words after a colon that are no variables
TIME_FORMATS = (
    "HH", "HH12", "HH24", "MI", "SS", "SSSSS", "FF", "FF1", "FF2", "FF3", "FF4", "FF5", "FF6", "AM", "PM", "A", "P",
    "DD", "DY", "DAY", "MM", "MON", "MONTH", "YY", "YYYY", "RRRR", "RR", "YEAR", "DDD", "WW", "W", "Q", "J",
    "TZH", "TZM", "TZR", "TZD", "CC", "SCC", "SYYYY", "BC", "AD",
)
DB2_REGISTERS = ("CURRENT", "DATE", "TIME", "TIMESTAMP", "USER", "SCHEMA", "PATH", "TIMEZONE", "CLIENT_ACCTNG", "CLIENT_APPLNAME", "CLIENT_USERID", "CLIENT_WRKSTNNAME")
POSTGRESQL_TYPES = (
    "INTEGER", "INT", "BIGINT", "SMALLINT", "NUMERIC", "DECIMAL", "REAL", "FLOAT", "VARCHAR", "CHAR", "TEXT",
    "BOOLEAN", "BOOL", "DATE", "TIME", "TIMESTAMP", "JSON", "JSONB", "UUID", "BYTEA", "INTERVAL",
)
SINGLE_LETTERS = ("N", "Y")
# fixed value: where an INTO list ends
INTO = r"(?is)\bINTO\b(.*?)(?:\bFROM\b|\bWHERE\b|\bVALUES\b|;|$)"


def blacklist(*sets: tuple[str, ...], add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The words of some sets, each once, with some more and without some; in upper case."""
    left = {w.upper() for w in remove}
    return tuple(dict.fromkeys(w.upper() for words in (*sets, add) for w in words if w.upper() not in left))


def word_union(spark: SparkSession, sets: list[tuple[str, ...]], add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """The same over tables (``word``) of any length: the distinct words of sets and a table, without those of another, in upper case."""
    listed = spark.createDataFrame([(w,) for words in sets for w in words], "word string")
    every = listed if add is None else listed.unionByName(add.select("word"))
    upper = every.where("word is not null").select(F.upper("word").alias("word")).distinct()
    return upper if remove is None else upper.join(remove.select(F.upper("word").alias("word")), "word", "left_anti")


#: format models; one-letter ones are common variable names, so only ``blacklist`` with them leaves those out
BLACKLIST = blacklist(TIME_FORMATS, remove=("A", "P", "W", "Q", "J"))


def blacklisted(name: Column, words: tuple[str, ...] = BLACKLIST) -> Column:
    return F.upper(name).isin(*words)


def masked(text: Column) -> Column:
    """String literals replaced by empty ones, so that colons inside them are not variables."""
    return F.regexp_replace(text, r"'(?:[^']|'')*'", "''")


def variables(text: Column, words: tuple[str, ...] = BLACKLIST) -> Column:
    """All variables in order of place, with repeats."""
    found = F.regexp_extract_all(masked(text), F.lit(VARIABLE), F.lit(0))
    return F.filter(found, lambda v: ~blacklisted(name_of(v), words)) if words else found


def name_of(variable: Column) -> Column:
    return F.regexp_extract(variable, r"^:(\w+)", 1)


def parsed(variable: Column) -> Column:
    """struct(type, var_name, index, field_name, indicator) of one variable."""
    some = lambda pattern: F.nullif(F.regexp_extract(variable, pattern, 1), F.lit(""))
    index, field, indicator = some(r"\[([^\]]+)\]"), some(r"\.(\w+)"), some(r"(?<=[\w\]]):(\w+)$")
    base = F.when(field.isNotNull(), "struct").when(index.isNotNull(), "array").otherwise("simple")
    return F.struct(F.when(indicator.isNotNull(), F.concat(base, F.lit("_indicator"))).otherwise(base).alias("type"), name_of(variable).alias("var_name"), index.alias("index"), field.alias("field_name"), indicator.alias("indicator"))


def outputs(text: Column, kind: Column) -> Column:
    """Variables inside the INTO span of a select or fetch."""
    span = F.regexp_extract(masked(text), INTO, 1)
    return F.when(kind.isin("select", "fetch_into"), F.regexp_extract_all(span, F.lit(VARIABLE), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def inputs(text: Column, kind: Column) -> Column:
    """All others, told apart by place: the INTO span is cut out first."""
    rest = F.when(kind.isin("select", "fetch_into"), F.regexp_replace(masked(text), r"(?is)\bINTO\b.*?(?=\bFROM\b|\bWHERE\b|;|$)", " ")).otherwise(masked(text))
    return F.filter(F.regexp_extract_all(rest, F.lit(VARIABLE), F.lit(0)), lambda v: ~blacklisted(name_of(v)))


def inputs_by_value(text: Column, kind: Column) -> Column:
    """All variables but those that the INTO span also names, with repeats."""
    out = outputs(text, kind)
    return F.filter(variables(text), lambda v: ~F.array_contains(out, v))


def paired(host: Column, params: Column, filler: str = "-") -> Column:
    """Positional pairs of two lists, the shorter one filled up."""
    return F.transform(F.arrays_zip(host.alias("h"), params.alias("p")), lambda z: F.struct(F.coalesce(z["h"], F.lit(filler)).alias("host"), F.coalesce(z["p"], F.lit(filler)).alias("param")))


def naming_change(host: Column, param: Column) -> Column:
    """same, snake_to_camel, camel_to_snake or custom."""
    from .rewrite import camel, snake

    bare = F.regexp_replace(host, "^:", "")
    return F.when(bare == param, "same").when(camel(bare) == param, "snake_to_camel").when(snake(bare) == param, "camel_to_snake").otherwise("custom")
