"""Scanners that need state: embedded SQL blocks, comments, C elements, headers, chunks.

Each is a plain generator over one text, and runs in Arrow batches through
``scan_files``; a file is scanned in one pass.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import sqltree
from ..session import ship
from ..storage import spread

#: strings, characters, comments, directives, words and single signs of C
TOKEN = re.compile(r'(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<directive>^[ \t]*#(?:[^\n\\]|\\.|\\\n)*)|(?P<word>[A-Za-z_]\w*)|(?P<sign>[^\s\w])', re.S | re.M)
#: comments, strings, directives (with the end of the line before) and braces; as each begins with one sign, the rest is skipped quickly
_APART = re.compile(r'/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|\n[ \t]*#(?:[^\n\\]|\\.|\\\n)*|\{|\}', re.S)
_FIRST_DIRECTIVE = re.compile(r"[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.S)
_EXEC = re.compile(r"EXEC\s+SQL\b", re.I)
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|[^;'\"]+", re.S)


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str) -> None:
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1


def comments(text: str) -> Iterator[dict]:
    """Comments outside strings."""
    line = Lines(text)
    for m in TOKEN.finditer(text):
        if m.lastgroup == "comment":
            yield {"start": m.start(), "end": m.end(), "line_start": line(m.start()), "line_end": line(m.end() - 1), "raw": m[0], "is_multiline": m[0].startswith("/*")}


def sql_blocks(text: str) -> Iterator[dict]:
    """EXEC SQL to the first semicolon outside quotes; those in comments or C strings, or without an end, are none."""
    if not _EXEC.search(text):
        return
    line = Lines(text)
    hidden = []
    if '"' in text or "/*" in text or "//" in text:
        first = _FIRST_DIRECTIVE.match(text)
        hidden = [(m.start(), m.end()) for m in _APART.finditer(text, first.end() if first else 0) if text[m.start()] in '/"']
    starts = [a for a, _ in hidden]
    at = 0
    while m := _EXEC.search(text, at):
        k = bisect_right(starts, m.start()) - 1
        if k >= 0 and hidden[k][0] <= m.start() < hidden[k][1]:
            at = hidden[k][1]
            continue
        end = m.end()
        while end < len(text) and text[end] != ";":
            q = _QUOTED.match(text, end)
            end = q.end() if q else len(text)
        if end >= len(text):
            at = m.end()
            continue
        at = end + 1
        yield {"start": m.start(), "end": at, "line_start": line(m.start()), "line_end": line(end), "raw": text[m.start() : at]}


def _blank(text: str) -> str:
    """Spaces of the same length, with the same line ends."""
    return "\n".join(" " * len(part) for part in text.split("\n"))


def _without(text: str, blocks: Iterable[dict]) -> str:
    """The text with embedded SQL, which is no C, as spaces."""
    edges = [0, *(x for b in blocks for x in (b["start"], b["end"])), len(text)]
    return "".join(_blank(text[a:b]) if k % 2 else text[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:])))


def _outer_tokens(text: str) -> list[tuple] | None:
    """Tokens outside braces, and all braces; None where braces or parentheses do not pair up, since then tokens inside count too."""
    held, at, depth, level = [], 0, 0, 0
    while m := (_APART if depth else TOKEN).search(text, at):
        at, sign = m.end(), text[m.start()]
        if sign not in "{}" and (depth or m.lastgroup in ("comment", "directive")):
            continue
        held.append((None if depth else m.lastgroup, m[0], m.start(), at))
        depth += (sign == "{") - (sign == "}")
        level += (sign == "(") - (sign == ")")
        if depth < 0 or level < 0 or sign == "{" and level:
            return None
    return None if depth or level else held


_KEYWORDS = frozenset({"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "goto"})
_DECLARED = re.compile(r"^[ \t]*((?:static\s+|extern\s+|const\s+|unsigned\s+|signed\s+|struct\s+)*(?:int|char|long|short|float|double|void|[A-Za-z_]\w*_t|VARCHAR)\s*\**)\s*(\w+)\s*((?:\[[^\]]*\])*)\s*(?:=[^;]*)?;", re.M)
C_KINDS = ("function", "function_call", "struct", "variable")


def c_elements(text: str, kinds: Collection[str] = C_KINDS) -> Iterator[dict]:
    """Functions, their calls, global and local declarations and structs, from one pass over tokens; only the kinds asked for are looked for."""
    line, text = Lines(text), _without(text, sql_blocks(text))
    if any(kind != "variable" for kind in kinds):
        yield from (e for e in _nested_elements(text, line, "function_call" in kinds) if e["kind"] in kinds)
    if "variable" in kinds:
        for m in _DECLARED.finditer(text):
            yield {"kind": "variable", "name": m[2], "line_start": line(m.start(2)), "line_end": line(m.end() - 1), "raw": m[0].strip(), "parent": None, "data_type": " ".join(m[1].split()), "args": m[3]}


def outline(text: str) -> Iterator[dict]:
    """Embedded SQL blocks (kind ``sql``) and functions, for those who need both: the blocks are looked for once."""
    blocks = list(sql_blocks(text))
    for b in blocks:
        yield {"kind": "sql", "name": None, **b}
    for e in _nested_elements(_without(text, blocks), Lines(text), False):
        if e["kind"] == "function":
            yield {"start": None, "end": None, **e}


def _nested_elements(text: str, line: Lines, calls: bool) -> Iterator[dict]:
    """Functions and structs, with ``calls`` those inside functions too."""
    tokens = None if calls else _outer_tokens(text)
    if tokens is None:
        tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup not in ("comment", "directive")]
    depth, k, function, open_at = 0, 0, None, 0

    def closing(k: int, left: str, right: str) -> int:
        level = 0
        while k < len(tokens):
            level += (tokens[k][1] == left) - (tokens[k][1] == right)
            if not level:
                return k
            k += 1
        return len(tokens) - 1

    while k < len(tokens):
        kind, word, start, end = tokens[k]
        if word == "{":
            depth += 1
        elif word == "}":
            depth -= 1
            if not depth and function:
                yield {"kind": "function", "name": function, "line_start": line(open_at), "line_end": line(start), "raw": text[open_at:end], "parent": None, "data_type": None, "args": None}
                function = None
        elif kind == "word" and word in ("struct", "typedef") and not depth:
            stop = k
            while stop < len(tokens) and tokens[stop][1] not in ("{", ";", "("):
                stop += 1
            if stop < len(tokens) and tokens[stop][1] == "{":
                last = closing(stop, "{", "}")
                name = tokens[last + 1][1] if last + 1 < len(tokens) and tokens[last + 1][0] == "word" else tokens[k + 1][1]
                yield {"kind": "struct", "name": name, "line_start": line(start), "line_end": line(tokens[last][2]), "raw": text[start : tokens[last][3]], "parent": None, "data_type": None, "args": None}
                k = last
        elif kind == "word" and k + 1 < len(tokens) and tokens[k + 1][1] == "(" and word not in _KEYWORDS:
            last = closing(k + 1, "(", ")")
            after = tokens[last + 1][1] if last + 1 < len(tokens) else ""
            if not depth and after == "{":
                function, open_at = word, tokens[k - 1][2] if k and tokens[k - 1][0] == "word" and line(tokens[k - 1][2]) == line(start) else start
                k = last
            elif depth and function:
                yield {"kind": "function_call", "name": word, "line_start": line(start), "line_end": line(tokens[last][2]), "raw": text[start : tokens[last][3]], "parent": function, "data_type": None, "args": text[tokens[k + 1][3] : tokens[last][2]].strip()}
        k += 1


def _blanked(text: str) -> str:
    """The text with comments, strings, directives and embedded SQL as spaces: all places stay."""
    gone = [(m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup in ("comment", "string", "directive")] + [(b["start"], b["end"]) for b in sql_blocks(text)]
    out, at = [], 0
    for a, b in sorted(gone):
        if b > at:
            out += [text[at : max(a, at)], _blank(text[max(a, at) : b])]
            at = b
    return "".join(out) + text[at:]


_ASSIGNED = re.compile(r"(?<![\w.>])([A-Za-z_]\w*)\s*((?:\[[^\]]*\]\s*)*)[-+*/%&|^]?=(?!=)([^;{}]*);")
_FIELD = re.compile(r"\b([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*(->|\.)\s*([A-Za-z_]\w*)\s*(=(?!=))?")


def assignments(text: str) -> Iterator[dict]:
    """Variables that are set, initial values too, and the expressions that they are set to; in ``a = b = c`` each is one."""
    line, plain = Lines(text), _blanked(text)
    for m in _ASSIGNED.finditer(plain):
        targets, rest = [m[1]], m[3]
        while inner := re.match(r"\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*=(?!=)(.*)", rest, re.S):
            targets.append(inner[1])
            rest = inner[2]
        for target in targets:
            yield {"target": target, "expression": " ".join(rest.split()), "line_start": line(m.start(1)), "line_end": line(m.end() - 1)}


def field_uses(text: str) -> Iterator[dict]:
    """Members of structures that are read or written (before a single ``=``)."""
    line = Lines(text)
    for m in _FIELD.finditer(_blanked(text)):
        yield {"struct": m[1], "field": m[3], "access": "write" if m[4] else "read", "is_pointer": m[2] == "->", "line_start": line(m.start())}


def declare_sections(text: str) -> Iterator[dict]:
    """Spans and bodies of declare sections, from a BEGIN block to the next END; one that never ends is none, nor one in a comment or string."""
    begun = None
    for b in sql_blocks(text):
        words = b["raw"][:-1].upper().split()[2:]
        if words == ["BEGIN", "DECLARE", "SECTION"] and begun is None:
            begun = b
        elif words == ["END", "DECLARE", "SECTION"] and begun is not None:
            yield {"start": begun["start"], "end": b["end"], "line_start": begun["line_start"], "line_end": b["line_end"], "raw": text[begun["end"] : b["start"]].strip("\n")}
            begun = None


def plain_blocks(text: str) -> Iterator[dict]:
    """EXEC SQL up to the next semicolon, whatever stands between: the form that older tools cut by."""
    line = Lines(text)
    for m in re.finditer(r"EXEC\s+SQL\s+(.*?);", text, re.S | re.I):
        yield {"start": m.start(), "end": m.end(), "line_start": line(m.start()), "line_end": line(m.end() - 1), "raw": m[1]}


def normalized_tokens(text: str, alias: Callable[[str], str] | None = None) -> Iterator[dict]:
    """A statement with its variables as ``?`` (or ``:v AS alias``), and the variables it reads and sets, in order.

    What goes: the prefix, an array clause, semicolons, and the INTO list of a
    SELECT or FETCH, up to the FROM of its own level. A colon after a digit belongs
    to a time; an indicator is a variable of its own.
    """
    held = sqltree.tokens(text)
    seen = [k for k, t in enumerate(held) if t.kind not in ("space", "comment")]
    gone, sets = set(), set()

    def drop(a: int, b: int) -> None:
        gone.update(range(a, b + 1 + (b + 1 < len(held) and held[b + 1].kind == "space")))

    if [held[k].word for k in seen[:2]] == ["EXEC", "SQL"]:
        drop(seen[0], seen[1])
        seen = seen[2:]
    inputs, outputs = [], []
    if len(seen) > 2 and held[seen[0]].word == "FOR" and held[seen[2]].word in ("INSERT", "UPDATE", "DELETE"):
        drop(seen[0], seen[1])
        if held[seen[1]].kind == "variable":
            inputs.append(held[seen[1]].text)
        seen = seen[2:]
    if seen and held[seen[0]].word in ("SELECT", "FETCH"):
        for k in (k for k in seen if held[k].word == "INTO"):
            end = next((j for j in sqltree.along(held, k) if held[j].word == "FROM"), len(held))
            sets.update(range(k, end))
    out = []
    for k, t in enumerate(held):
        if k in gone or t.text == ";":
            continue
        if t.kind == "variable":
            main, _, indicator = t.text[1:].partition(":")
            (outputs if k in sets else inputs).extend(":" + v for v in (main, indicator) if v)
            new = f":{main} AS {alias(main.split('[')[0])}" if alias else "?"
        else:
            new = " " if t.kind == "space" else t.text
        if k not in sets:
            out.append(new)
    yield {"sql": "".join(x for x, before in zip(out, ["", *out]) if x != " " or before != " ").strip(), "inputs": inputs, "outputs": outputs}


_INCLUDE = re.compile(r"""#\s*include\s*(?:<([^>]+)>|"([^"]+)")""")
_DEFINE = re.compile(r"#\s*define\s+(\w+)(?![\w(])[ \t]*(.*)", re.S)
_SQL_INCLUDE = re.compile(r"""EXEC\s+SQL\s+INCLUDE\s+["']?([\w./]+)["']?\s*;""", re.I)


def directives(text: str) -> Iterator[dict]:
    """Includes (system, local, SQL) and macros with values, outside comments and strings; macros with parameters are left out."""
    line = Lines(text)
    first = _FIRST_DIRECTIVE.match(text)
    found = [(0, first[0].strip())] if first else []
    found += [(m.start() + 1, m[0].strip()) for m in _APART.finditer(text, first.end() if first else 0) if text[m.start()] == "\n"]
    for start, raw in sorted(found + [(b["start"], b["raw"]) for b in sql_blocks(text)]):
        if m := _SQL_INCLUDE.match(raw):
            yield {"kind": "include", "name": m[1], "value": "sql", "line_start": line(start)}
        elif m := _INCLUDE.match(raw):
            yield {"kind": "include", "name": m[1] or m[2], "value": "system" if m[1] else "local", "line_start": line(start)}
        elif m := _DEFINE.match(raw):
            value = "".join(" " if x.lastgroup == "comment" else x[0] for x in _MACRO_PART.finditer(m[2].replace("\\\n", " ")))
            yield {"kind": "macro", "name": m[1], "value": value.strip() or None, "line_start": line(start)}


_MACRO_PART = re.compile(r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<text>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[^"'/]+|.)""", re.S)


_NAME, _HEX, _OPERAND = re.compile(r"[A-Za-z_]\w*"), re.compile(r"0[xX][0-9A-Fa-f]+"), re.compile(r"0[xX][0-9A-Fa-f]+|\d+|[A-Za-z_]\w*|\S")


def constant(text: str, macros: dict[str, str] | None = None) -> int | None:
    """A constant integer expression of digits, macros, + - * / % and parentheses; None if it is none.

    Macros may stand for others, however long the chain; one that leads back to itself has no value.
    """
    macros, known, waiting = macros or {}, {}, [None]
    while True:
        name = waiting[-1]
        expression = text if name is None else macros[name]
        names = [w for w in _NAME.findall(_HEX.sub("0", expression or "")) if w in macros and w not in known]
        if any(w in waiting for w in names):
            known |= {w: None for w in names if w in waiting}
        elif names:
            waiting.append(names[0])
        else:
            value = _evaluated(expression or "", known)
            waiting.pop()
            if name is None:
                return value
            known.setdefault(name, value)


def _evaluated(text: str, known: dict[str, int | None]) -> int | None:
    tokens = _OPERAND.findall(text)
    k = 0

    def atom() -> int:
        nonlocal k
        t = tokens[k]
        k += 1
        if t == "(":
            value = total()
            if tokens[k] != ")":
                raise ValueError(t)
            k += 1
            return value
        if t in "+-":
            return atom() * (1 if t == "+" else -1)
        if t[0].isdigit():
            return int(t, 16 if t[:2].lower() == "0x" else 10)
        if known.get(t) is None:
            raise ValueError(t)
        return known[t]

    def product() -> int:
        nonlocal k
        value = atom()
        while k < len(tokens) and tokens[k] in "*/%":
            sign, other = tokens[k], None
            k += 1
            other = atom()
            value = value * other if sign == "*" else int(value / other) if sign == "/" else value % other
        return value

    def total() -> int:
        nonlocal k
        value = product()
        while k < len(tokens) and tokens[k] in "+-":
            sign = tokens[k]
            k += 1
            other = product()
            value = value + other if sign == "+" else value - other
        return value

    try:
        value = total()
        return value if k == len(tokens) else None
    except (ValueError, IndexError, KeyError, ZeroDivisionError, RecursionError):
        return None


_STP = re.compile(r"(\w+_stp)\s*\[\s*\]\s*=\s*\{(.*?)\}\s*;", re.S)
_STP_ENTRY = re.compile(r"\{\s*'(.|\\0)'\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*\d+\s*\}")
_STRUCT = re.compile(r"typedef\s+struct\s*\w*\s*\{(.*?)\}\s*(\w+)\s*;", re.S)
_STRUCT_FIELD = re.compile(r"^[ \t]*([A-Za-z_][\w ]*?)[ \t]+(\w+)[ \t]*((?:\[[^\]]*\])*)[ \t]*;[ \t]*(?:/\*(.*?)\*/|//([^\n]*))?", re.M)
_BOUND = re.compile(r"\[([^\]]*)\]")


def header_fields(text: str) -> Iterator[dict]:
    """Fields of typedef structs, with sizes from their own STP arrays or array bounds (9 without either)."""
    macros = {d["name"]: d["value"] for d in directives(text) if d["kind"] == "macro" and d["value"]}
    stps = {m[1]: [(c, int(a), int(b)) for c, a, b in _STP_ENTRY.findall(m[2])] for m in _STP.finditer(text)}
    for m in _STRUCT.finditer(text):
        codes = []
        for code, size, decimal in stps.get(re.sub("_t$", "_stp", m[2]), []):
            if code in ("\\0", "0"):
                break
            if code not in "wg":
                codes.append((code, size, decimal))
        fields = _STRUCT_FIELD.findall(m[1])
        for k, (dtype, name, bounds, a, b) in enumerate(fields):
            first = _BOUND.match(bounds)
            bound = constant(first[1], macros) if first else None
            code, size, decimal = codes[k] if k < len(codes) else (None, None, 0)
            yield {"struct_name": m[2], "ordinal": k, "name": name, "dtype": dtype, "size": size if size is not None and code in "odil" else bound if bound is not None else 9, "decimal": decimal or 0, "description": (a or b).strip() or None, "array_size": bound}


def chunks(text: str, size: int = 4000, overlap: int = 200, near: int = 500) -> Iterator[dict]:
    """Windows of about ``size`` characters that end after a statement where one ends nearby; always moving on."""
    at, k = 0, 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            ends = [m.end() for m in re.finditer(r";\s*\n", text[max(at, end - near) : end + near])]
            if ends:
                end = max(at, end - near) + min(ends, key=lambda e: abs(e - near))
        yield {"chunk": k, "start": at, "end": end, "raw": text[at:end]}
        if end >= len(text):
            return
        at, k = max(end - overlap, at + 1), k + 1


#: bytes of files whose elements are held at a time
BATCH_BYTES = 4 << 20
_SPAN = "start long, end long, line_start long, line_end long, raw string"
SCANS: dict[str, tuple[Callable[[str], Iterator[dict]], str]] = {
    "sql": (sql_blocks, _SPAN),
    "comment": (comments, _SPAN + ", is_multiline boolean"),
    "c": (c_elements, "kind string, name string, line_start long, line_end long, raw string, parent string, data_type string, args string"),
    "outline": (outline, "kind string, name string, " + _SPAN),
    "directive": (directives, "kind string, name string, value string, line_start long"),
    "header": (header_fields, "struct_name string, ordinal int, name string, dtype string, size int, decimal int, description string, array_size int"),
    "section": (declare_sections, _SPAN),
    "plain_sql": (plain_blocks, _SPAN),
    "tokens": (normalized_tokens, "sql string, inputs array<string>, outputs array<string>"),
    "assignment": (assignments, "target string, expression string, line_start long, line_end long"),
    "field": (field_uses, "struct string, field string, access string, is_pointer boolean, line_start long"),
    "chunk": (chunks, "chunk int, start long, end long, raw string"),
}


def scan_files(files: DataFrame, what: str, key: str = "file_id", text: str = "content", fields: Collection[str] = (), **options) -> DataFrame:
    """One row for each element that a scanner finds; a null text has none. ``seq`` is the order in the file; ``options`` go to the scanner.

    Of ``fields`` only those named are made, all without any: Spark can't leave out what Python returns.
    """
    scan, known = SCANS[what]
    scan = partial(scan, **options) if options else scan
    whole = T._parse_datatype_string(f"{key} {files.schema[key].dataType.simpleString()}, seq int, {known}")
    schema = T.StructType([f for f in whole.fields if not fields or f.name == key or f.name in fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1)))  # some files' elements at a time
            for at in range(0, batch.num_rows, step):
                rows = [(k, n, row) for k, t in zip(*(c.to_pylist() for c in batch.slice(at, step).columns)) for n, row in enumerate(scan(t or ""))]
                made = [[r[0] for r in rows] if f.name == key else [r[1] for r in rows] if f.name == "seq" else [r[2][f.name] for r in rows] for f in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(made, arrow)], schema=arrow)

    ship(files.sparkSession)
    return spread(files.select(key, text)).mapInArrow(run, schema)
