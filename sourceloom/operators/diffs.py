"""Differences of texts: the shortest edit script as rows with ranges, similarity, unified form.

The script is Myers' in linear space: the middle of a shortest path splits a pair of
sequences in two, from a stack, so memory grows with the longer one only. Tokens
that one side alone has can't match and are set aside first, which changes nothing
but the time; so are equal beginnings and ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.sqltree import as_column
from ..session import ship

_TOKEN = re.compile(r"\w+|[^\w\s]")
#: rows compared before results are passed on
BATCH_ROWS = 256


def _middle(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """The run of equal tokens (from, to) in the middle of a shortest path."""
    n, m = a1 - a0, b1 - b0
    apart = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            at = x
            while x < n and y < m and a[a0 + x] == b[b0 + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if apart % 2 and -d < apart - k < d and x + back[apart - k] >= n:
                return a0 + at, b0 + at - k, a0 + x, b0 + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            at = x
            while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not apart % 2 and -d <= apart - k <= d and x + ahead[apart - k] >= n:
                return a1 - x, b1 - y, a1 - at, b1 - (at - k)
    raise AssertionError("paths from both ends meet")


def equal_runs(a: list, b: list) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the runs that a shortest edit script keeps, in order."""
    both = set(a) & set(b)
    at_a, at_b = [k for k, x in enumerate(a) if x in both], [k for k, x in enumerate(b) if x in both]
    a, b = [a[k] for k in at_a], [b[k] for k in at_b]
    kept, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            kept.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            kept.append((a1, b1))
        if a0 < a1 and b0 < b1:
            i0, j0, i1, j1 = _middle(a, b, a0, a1, b0, b1)
            kept += zip(range(i0, i1), range(j0, j1))
            stack += [(a0, i0, b0, j0), (i1, a1, j1, b1)]
    runs: list[tuple[int, int, int]] = []
    for i, j in sorted(kept):
        i, j = at_a[i], at_b[j]
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((i, j, 1))
    return runs


def edits(a: list, b: list) -> tuple[list[tuple[str, int, int, int, int]], int]:
    """replace, delete and insert with the places in both; and how many tokens stay."""
    out, i, j, same = [], 0, 0, 0
    for x, y, n in [*equal_runs(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j, same = x + n, y + n, same + n
    return out, same


def token_edits(a: str, b: str, ignore_case: bool = False) -> tuple[list[tuple[str, int, int, int, int]], float]:
    """Edits of the tokens (words and signs, white space aside) as ranges of characters; and the share of tokens that stay.

    A side without tokens in an edit has an empty range after the token before.
    """
    found = [[(m.start(), m.end(), m[0].lower() if ignore_case else m[0]) for m in _TOKEN.finditer(t)] for t in (a, b)]
    ops, same = edits(*([x[2] for x in side] for side in found))

    def span(side: int, first: int, last: int) -> tuple[int, int]:
        tokens = found[side]
        place = tokens[first - 1][1] if first else 0
        return (tokens[first][0], tokens[last - 1][1]) if first < last else (place, place)

    total = len(found[0]) + len(found[1])
    return [(op, *span(0, i0, i1), *span(1, j0, j1)) for op, i0, i1, j0, j1 in ops], 2 * same / total if total else 1.0


def _by_pair(pairs: DataFrame, a: str, b: str, fields: str, make) -> DataFrame:
    """The pairs' columns beside the rows that ``make(text, text)`` gives for each; null texts are empty."""
    ship(pairs.sparkSession)
    schema = T.StructType(list(pairs.schema.fields) + T._parse_datatype_string(fields).fields)
    arrow = to_arrow_schema(schema)
    new = [f.name for f in schema.fields[len(pairs.columns) :]]
    at = [pairs.columns.index(a), pairs.columns.index(b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                made = [make(x or "", y or "") for x, y in zip(*(part.column(k).to_pylist() for k in at))]
                owner = pa.array([k for k, rows in enumerate(made) for _ in rows], pa.int64())
                rows = [r for some in made for r in some]
                columns = list(part.take(owner).columns) + [pa.array([r[k] for r in rows], arrow.field(name).type) for k, name in enumerate(new)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pairs.mapInArrow(run, schema)


RANGES = "op string, a_start int, a_end int, b_start int, b_end int"


def diff_ranges(pairs: DataFrame, a: str = "sql", b: str = "parsed_sql", ignore_case: bool = False) -> DataFrame:
    """A row for each edit of a pair, beside the pair's columns: op, a_start, a_end, b_start, b_end."""
    return _by_pair(pairs, a, b, RANGES, lambda x, y: token_edits(x, y, ignore_case)[0])


def diff_summary(pairs: DataFrame, a: str = "sql", b: str = "parsed_sql", ignore_case: bool = False) -> DataFrame:
    """The pairs with similarity, and the counts of replaced, deleted and inserted runs."""

    def summed(x: str, y: str) -> list[tuple]:
        ops, similarity = token_edits(x, y, ignore_case)
        kinds = [o[0] for o in ops]
        return [(round(similarity, 6), *(kinds.count(k) for k in ("replace", "delete", "insert")))]

    return _by_pair(pairs, a, b, "similarity double, replaced long, deleted long, inserted long", summed)


def unified(a: str, b: str, context: int = 3) -> str:
    """The lines that differ, with lines around them, as hunks of a unified diff; empty where nothing differs."""
    left, right = a.splitlines(), b.splitlines()
    hunks: list[list[tuple[str, int, int, int, int]]] = []
    for op in edits(left, right)[0]:
        if hunks and op[1] - hunks[-1][-1][2] <= 2 * context:
            hunks[-1].append(op)
        else:
            hunks.append([op])
    out = []
    for ops in hunks:
        i0, i1 = max(0, ops[0][1] - context), min(len(left), ops[-1][2] + context)
        j0, j1 = ops[0][3] - (ops[0][1] - i0), ops[-1][4] + (i1 - ops[-1][2])
        place = lambda x, y: f"{x + (x < y)}" + ("" if y - x == 1 else f",{y - x}")
        out.append(f"@@ -{place(i0, i1)} +{place(j0, j1)} @@")
        at = i0
        for _, a0, a1, b0, b1 in ops:
            out += [f" {x}" for x in left[at:a0]] + [f"-{x}" for x in left[a0:a1]] + [f"+{x}" for x in right[b0:b1]]
            at = a1
        out += [f" {x}" for x in left[at:i1]]
    return "\n".join(out)


def unified_diff(a: Column, b: Column, context: int = 3) -> Column:
    """A unified diff of two texts' lines, without file names."""
    return as_column(lambda x, y: unified(x, y or "", context), "string", F.coalesce(a, F.lit("")), b)


class DiffRanges:
    """``diff_ranges(a, b)`` for SQL; see ``register``."""

    def eval(self, a: str | None, b: str | None) -> Iterator[tuple]:
        yield from token_edits(a or "", b or "")[0]


def register(spark: SparkSession) -> None:
    """``diff_ranges`` as a table function: SELECT ... FROM pairs, LATERAL diff_ranges(sql, parsed_sql)."""
    ship(spark)
    spark.udtf.register("diff_ranges", F.udtf(DiffRanges, returnType=RANGES))
