"""SQL that a program builds in string buffers: what a buffer holds where it is prepared.

The string calls and the PREPARE statements of a function are one ordered stream; a
task folds it line by line and keeps the text of each buffer, and a PREPARE gives
out its buffer's text as it is then. Only the buffers of one function are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: what stands for a value that is not known
UNKNOWN = "?"
# fixed values: string calls, with the place of the source (or format) and of the size among their arguments
COPIES = {"strcpy": (1, None), "strncpy": (1, 2)}
JOINS = {"strcat": (1, None), "strncat": (1, 2)}
FORMATS = {"sprintf": (1, None), "snprintf": (2, 1)}
_STEP = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[(),]|[^"\'(),]+|.', re.S)
_STRING = re.compile(r'"((?:\\.|[^"\\])*)"', re.S)
_CONVERSION = re.compile(r"%(?:%|([-+ #0]*)(\d+|\*)?(?:\.(\d+|\*))?(?:hh|h|ll|l|q|L|j|z|t)?([A-Za-z]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
PREPARED = r"(?is)\bPREPARE\s+(\w+)\s+FROM\s+:?(\w+)"


def arguments(text: str) -> list[str]:
    """C arguments, cut at commas outside quotes and parentheses."""
    out, depth = [""], 0
    for m in _STEP.finditer(text):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == "," and not depth:
            out.append("")
        else:
            out[-1] += m[0]
    return [x.strip() for x in out] if text.strip() else []


def _buffer(expression: str) -> str:
    """The buffer that an argument names: casts, & and white space go."""
    return re.sub(r"^(?:\(\s*[\w\s]+\*+\s*\)\s*)?&?", "", expression).strip()


def _value(expression: str, buffers: dict[str, str]) -> str:
    literals = _STRING.findall(expression)
    if literals and not _STRING.sub("", expression).strip():  # adjacent literals are one
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), "".join(literals), flags=re.S)
    if re.fullmatch(r"'(?:\\.|[^'\\])'", expression):
        return expression[1:-1]
    return buffers.get(_buffer(expression), UNKNOWN)


def formatted(template: str, args: list[str], buffers: dict[str, str]) -> str:
    """A format with its arguments put in: texts and whole numbers that are known, ``?`` for others and for those that are missing."""
    left = iter(args)

    def one(m: re.Match) -> str:
        if m[4] is None:
            return "%"
        flags, width, precision, kind = m[1], m[2], m[3], m[4]
        if width == "*" or precision == "*":
            for w in (width, precision):
                if w == "*":
                    next(left, None)
            next(left, None)
            return UNKNOWN
        arg = next(left, None)
        if arg is None:
            return UNKNOWN
        if kind in "diuxXo" and re.fullmatch(r"[-+]?\d+[uUlL]*", arg):
            return f"%{flags}{width or ''}{'.' + precision if precision else ''}{'d' if kind in 'iu' else kind}" % int(arg.rstrip("uUlL"))
        value = _value(arg, buffers) if kind in "sc" else UNKNOWN
        if value == UNKNOWN or kind == "c":
            return value
        value = value[: int(precision)] if precision else value
        return value.ljust(int(width)) if width and "-" in flags else value.rjust(int(width or 0))

    return _CONVERSION.sub(one, template)


def _sized(value: str, args: list[str], at: int | None, less: int = 0) -> str:
    """No more than a size that is a plain number allows."""
    if at is None or at >= len(args) or not args[at].isdigit():
        return value
    return value[: max(0, int(args[at]) - less)]


def applied(name: str, text: str, buffers: dict[str, str]) -> str | None:
    """Carry out a string call on the buffers; the text it wrote, or None if it is none."""
    args = arguments(text)
    source, size = (COPIES | JOINS | FORMATS).get(name, (None, None))
    if source is None or source >= len(args):
        return None
    target = _buffer(args[0])
    if name in FORMATS:
        new = _sized(formatted(_value(args[source], buffers), args[source + 1 :], buffers), args, size, 1)
    else:
        new = _sized(_value(args[source], buffers), args, size)
    buffers[target] = buffers.get(target, "") + new if name in JOINS else new
    return new


def prepared_sql(calls: DataFrame, prepares: DataFrame) -> DataFrame:
    """file_id, function, prepare_line, name, buffer, sql_text, confidence, operations of each PREPARE.

    ``calls``: file_id, function, line_start, line_end, name, args (as scanned);
    ``prepares``: file_id, function, line_start, sql_text. A call counts if it ends
    on a line before the PREPARE, in the same function (null: outside all).
    ``sql_text`` is null where nothing was written to the buffer; confidence falls by
    0.05 for each string call before, and by 0.1 for each that wrote something unknown.
    """
    names = [*COPIES, *JOINS, *FORMATS]
    none = F.lit(None).cast("string")
    stream = (
        calls.where(F.col("name").isin(*names))
        .select("file_id", "function", F.col("line_end").alias("line"), F.col("line_start").alias("first"), F.lit(1).alias("kind"), "name", F.col("args").alias("text"))
        .unionByName(
            prepares.where(F.regexp_like("sql_text", F.lit(PREPARED))).select(
                "file_id", "function", F.col("line_start").alias("line"), F.col("line_start").alias("first"), F.lit(0).alias("kind"), F.regexp_extract("sql_text", PREPARED, 1).alias("name"), F.regexp_extract("sql_text", PREPARED, 2).alias("text")
            )
        )
    )
    key = calls.schema["file_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"file_id {key}, function string, prepare_line long, name string, buffer string, sql_text string, confidence double, operations array<string>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buffers, operations, unknown = object(), {}, [], 0
        for batch in batches:
            out = []
            for file_id, function, line, kind, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (file_id, function) != now:
                    now, buffers, operations, unknown = (file_id, function), {}, [], 0
                if kind:
                    new = applied(name, text or "", buffers)
                    if new is not None:
                        operations.append(f"{name}({text})")
                        unknown += UNKNOWN in new
                else:
                    sql = buffers.get(text) or None
                    sure = max(0.0, min(1.0, 1 - 0.05 * len(operations) - 0.1 * unknown)) if sql else 0.0
                    out.append((file_id, function, line, name, text, sql, round(sure, 4), list(operations)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    ship(calls.sparkSession)
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stream.repartition(n, "file_id", "function").sortWithinPartitions("file_id", "function", "line", "kind", "first", "text")
    return dealt.select("file_id", "function", F.col("line").cast("long").alias("line"), "kind", "name", "text").mapInArrow(run, schema)
