"""Routing of texts by long tables of rules: one automaton finds all plain patterns at once.

Rules have a priority; the best one that a text meets wins. Plain patterns, case
aside, become one automaton over characters whose states know the best rule that
ends there, so a text is read once whatever the number of rules. Patterns with
signs of regular expressions are tried in order, as far as they are better than what the
automaton found. Longer tables are joined instead: each rule has a key that a text
must hold to meet it (a plain pattern itself, of an expression the longest piece that
it can't do without), and texts are cut into those pieces that begin and end as keys do.
Only expressions without such a piece are tried on all texts, in blocks.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from ..storage import spread, stored
from .sqltree import as_column

#: rules of one automaton
BLOCK_RULES = 20_000
_SIGNS = re.compile(r"[\\.^$*+?{}\[\]|()]")


class Automaton:
    """All patterns with their ranks; the least rank of those that a text holds."""

    def __init__(self, patterns: list[tuple[str, int]]) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.best: list[int | None] = [None]
        for pattern, rank in patterns:
            state = 0
            for letter in pattern:
                new = self.moves[state].get(letter)
                if new is None:
                    new = self.moves[state][letter] = len(self.moves)
                    self.moves.append({})
                    self.best.append(None)
                state = new
            self.best[state] = rank if self.best[state] is None else min(rank, self.best[state])
        self.back = [0] * len(self.moves)
        queue = deque(self.moves[0].values())
        while queue:
            state = queue.popleft()
            for letter, new in self.moves[state].items():
                at = self.back[state]
                while at and letter not in self.moves[at]:
                    at = self.back[at]
                at = self.moves[at].get(letter, 0)
                self.back[new] = at
                if self.best[at] is not None and (self.best[new] is None or self.best[at] < self.best[new]):
                    self.best[new] = self.best[at]
                queue.append(new)

    def least(self, text: str) -> int | None:
        moves, back, best = self.moves, self.back, self.best
        state, found = 0, best[0]
        for letter in text:
            while state and letter not in moves[state]:
                state = back[state]
            state = moves[state].get(letter, 0)
            here = best[state]
            if here is not None and (found is None or here < found):
                found = here
        return found


class Rules:
    """Rules (rank, target, pattern) by rank."""

    def __init__(self, rules: list[tuple[int, str, str]]) -> None:
        self.target = {rank: target for rank, target, _ in rules}
        plain = [(p.lower(), rank) for rank, _, p in rules if not _SIGNS.search(p)]
        self.tried = []
        for rank, _, p in rules:
            if _SIGNS.search(p):
                plain.append((p.lower(), rank))  # as it stands in the text, too
                try:
                    self.tried.append((rank, re.compile(p, re.I)))
                except re.error:
                    pass
        self.tried.sort(key=lambda x: x[0])
        self.automaton = Automaton(plain)

    def route(self, text: str) -> str | None:
        found = self.automaton.least(text.lower())
        for rank, pattern in self.tried:
            if found is not None and rank > found:
                break
            if pattern.search(text):
                found = rank
                break
        return None if found is None else self.target[found]


def routed(df: DataFrame, rules: DataFrame, text: str, default: str | None = None, name: str = "target", block_rules: int = BLOCK_RULES) -> DataFrame:
    """The rows with the target of the best of some rules (target, priority, ord, pattern) that their text meets, else ``default``.

    Higher priorities come first, then lower ``ord``. A pattern is met as a
    regular expression, case aside, or as it stands; one that is no expression only as it
    stands. A null text meets nothing, an empty pattern is met by any other.
    """
    ship(df.sparkSession)
    table = rules.where("pattern is not null").orderBy(F.desc("priority"), "ord", "target", "pattern").select("target", "pattern")
    columns = df.columns
    block = [(rank, row.target, row.pattern) for rank, row in enumerate(table.limit(block_rules + 1).collect())]
    if len(block) > block_rules:
        # ids rise with the rows' order, and stay as they are once they are stored
        numbered = stored(table.withColumn("rank", F.monotonically_increasing_id()))
        rows = stored(df.drop(name).withColumn("_row", F.monotonically_increasing_id()))
        found = _joined(rows.select("_row", F.col(f"`{text}`").alias("text")).where("text is not null"), numbered, block_rules)
        found = found.join(numbered.select("rank", F.col("target").alias(name)), "rank").drop("rank")
        out = rows.join(found, "_row", "left")
    else:
        out = df.withColumn(name, F.lit(None).cast("string"))
        out = _with_block(out, block, text, name) if block else out
    return out.select(*(F.col(f"`{c}`") for c in columns if c != name), F.coalesce(name, F.lit(default)).alias(name))


#: keys' beginnings, lengths and last characters that a task holds to cut texts by
MOST_SHAPES = 200_000
#: what matches an ASCII letter, case aside, but does not become it in lower case
_KIN = {0x17F: "s", 0x212A: "k", 0x131: "i", 0x130: "i"}


def required(pattern: str) -> str:
    """The longest piece of ASCII characters, in lower case, that whatever meets an expression holds; empty if none is sure."""
    if "|" in pattern or "(?" in pattern:
        return ""
    runs, depth, at = [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "\\":
            if pattern[at : at + 1].isalnum() and pattern[at] not in "bBdDsSwWAZ":
                break
            at += 1
        elif c == "[":
            at += pattern[at : at + 1] == "^"
            at += pattern[at : at + 1] == "]"
            while at < len(pattern) and pattern[at] != "]":
                at += 1 + (pattern[at] == "\\")
            at += 1
        elif c == "{":
            runs[-1] = runs[-1][:-1]
            if "}" not in pattern[at:]:
                break
            at = pattern.index("}", at) + 1
        elif c in "*?":
            runs[-1] = runs[-1][:-1]
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in "^$.+}]" and c.isascii():
            if not depth:
                runs[-1] += c
            continue
        runs.append("")
    return max(runs, key=len).lower()


def is_expression(pattern: str) -> bool:
    """Whether a pattern has signs of an expression and is one."""
    try:
        return bool(_SIGNS.search(pattern) and re.compile(pattern, re.I))
    except re.error:
        return False


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


def _joined(texts: DataFrame, rules: DataFrame, block_rules: int) -> DataFrame:
    """_row, rank: for each of some texts (_row, text) the least rank of the rules (rank, pattern) that it meets, by joins on keys."""
    spark, pattern = texts.sparkSession, F.col("pattern")
    plain = rules.groupBy(as_column(str.lower, "string", pattern).alias("key")).agg(F.min("rank").alias("rank")).select("key", F.lit(None).cast("string").alias("expression"), "rank")
    expressions = rules.where(as_column(is_expression, "boolean", pattern))
    tried = expressions.select(as_column(required, "string", pattern).alias("key"), pattern.alias("expression"), "rank")
    keyed = stored(plain.unionByName(tried))
    loose = F.col("expression").isNotNull() & (F.col("key") == "")
    keys = keyed.where(~loose)

    for head in (4, 2, 0):  # fewer characters, where keys begin in too many ways
        end = F.substring("key", -1, 1) if head == 4 else F.lit("")
        shapes = keys.select(F.substring("key", 1, head).alias("head"), F.length("key").alias("length"), end.alias("end")).distinct().limit(MOST_SHAPES + 1).collect()
        if len(shapes) <= MOST_SHAPES:
            break
    by_head: dict[int, dict[str, list[tuple[int, str]]]] = {}
    for shape in shapes:
        by_head.setdefault(len(shape.head), {}).setdefault(shape.head, []).append((shape.length, shape.end))
    held = spark.sparkContext.broadcast(by_head)

    def pieces(text: str, by_head: dict[int, dict[str, list[tuple[int, str]]]]) -> set[str]:
        found, size = set(), len(text)
        for width, heads in by_head.items():
            for at in range(size - width + 1):
                for length, end in heads.get(text[at : at + width], ()):
                    if at + length <= size and (not end or text[at + length - 1] == end):
                        found.add(text[at : at + length])
        return found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out: list[list] = [[], [], []]
                for row, text in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    low, like = text.lower(), text.translate(_KIN).lower()
                    for how, some in ((0, low), (2, like)) if low != like else ((1, low),):
                        some = pieces(some, shapes)
                        out[0] += [row] * len(some)
                        out[1] += some
                        out[2] += [how] * len(some)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], names=["_row", "key", "how"])

    # ``how``: 0 as plain patterns see the text, 2 as expressions do, 1 where that is the same
    met = spread(texts).mapInArrow(cut, "_row long, key string, how int").join(keys, "key").where(F.when(F.col("expression").isNull(), F.col("how") < 2).otherwise(F.col("how") > 0))
    met = stored(met.select("_row", "expression", "rank"))
    asked = met.where("expression is not null").join(texts, "_row")
    checked = asked.where(as_column(lambda t, p: _compiled(p).search(t) is not None, "boolean", F.col("text"), F.col("expression")))
    found = met.where("expression is null").select("_row", "rank").unionByName(checked.select("_row", "rank"))
    block: list[tuple[str, int]] = []
    for row in keyed.where(loose).orderBy("rank").select("expression", "rank").toLocalIterator():
        block.append((row.expression, row.rank))
        if len(block) == block_rules:
            found, block = found.unionByName(_tried(texts, block)), []
    if block:
        found = found.unionByName(_tried(texts, block))
    return found.groupBy("_row").agg(F.min("rank").alias("rank"))


def _tried(texts: DataFrame, block: list[tuple[str, int]]) -> DataFrame:
    """_row, rank: the first expression of a block (expression, rank) that each text meets."""
    held = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(re.compile(p, re.I), rank) for p, rank in held.value]
        for batch in batches:
            found = [next((rank for p, rank in rules if p.search(t)), None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["_row", "rank"])

    return texts.mapInArrow(run, "_row long, rank long").where("rank is not null")


def _with_block(df: DataFrame, block: list[tuple[int, str, str]], text: str, name: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(block)
    arrow = to_arrow_schema(T.StructType(df.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(held.value)
        for batch in batches:
            texts, found = batch.column(text).to_pylist(), batch.column(name).to_pylist()
            new = [rules.route(t) if f is None and t is not None else f for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == name else batch.column(c) for c in arrow.names], schema=arrow)

    return df.mapInArrow(run, df.schema)
