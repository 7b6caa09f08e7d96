"""Extensions by name: scanners and relationships that SQL can call as table functions.

A scanner takes a text and gives rows: ``FROM files, LATERAL my_scan(content)``. A
relationship takes the rows of a table, partitioned and ordered as the query says, and
gives rows for each partition: ``FROM my_groups(TABLE(stmts) PARTITION BY file_id
ORDER BY line_start)``. Variable rules are patterns with a name and a priority that
together cut variables out of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltree import as_column
from ..session import ship
from .scanner import SCANS

Scan = Callable[[str], Iterable[dict]]
Fold = Callable[[list[Row]], Iterable[dict]]


@dataclass(frozen=True)
class VariableRule:
    """A pattern for variables; of overlapping matches the longer stays, then the rule of higher priority."""

    name: str
    pattern: str
    priority: int = 50


class Extensions:
    """Scanners, relationships and variable rules by name; ``install`` makes the first two known to a session."""

    def __init__(self) -> None:
        self.scans: dict[str, tuple[Scan, str]] = {f"scan_{name}": found for name, found in SCANS.items()}
        self.folds: dict[str, tuple[Fold, str]] = {}
        self.rules: dict[str, VariableRule] = {}

    def scanner(self, name: str, fields: str) -> Callable[[Scan], Scan]:
        """Register a function of a text that gives rows with ``fields``."""

        def add(scan: Scan) -> Scan:
            self.scans[name] = (scan, fields)
            return scan

        return add

    def relationship(self, name: str, fields: str) -> Callable[[Fold], Fold]:
        """Register a function of a partition's rows, in order, that gives rows with ``fields``."""

        def add(fold: Fold) -> Fold:
            self.folds[name] = (fold, fields)
            return fold

        return add

    def variable_rule(self, rule: VariableRule) -> "Extensions":
        """Register a rule; one of the same name is replaced."""
        self.rules[rule.name] = rule
        return self

    def unregister(self, name: str) -> bool:
        """Whether something of that name was there."""
        return any(held.pop(name, None) is not None for held in (self.scans, self.folds, self.rules))

    def install(self, spark: SparkSession) -> None:
        ship(spark)
        for name, (scan, fields) in self.scans.items():
            spark.udtf.register(name, F.udtf(_scanning(scan, fields), returnType=fields))
        for name, (fold, fields) in self.folds.items():
            spark.udtf.register(name, F.udtf(_folding(fold, fields), returnType=fields))

    def variables(self, df: DataFrame, text: str) -> DataFrame:
        """The rows with ``variables``: matches of all rules in order of place, as an array of ``rule=match``."""
        rules = [(r.name, re.compile(r.pattern), r.priority) for r in self.rules.values()]

        def found(t: str) -> list[str]:
            hits = [(m.start(), m.end(), priority, name, m[0]) for name, pattern, priority in rules for m in pattern.finditer(t) if m[0]]
            kept: list[tuple[int, int, int, str, str]] = []
            for hit in sorted(hits, key=lambda h: (h[0] - h[1], -h[2], h[0], h[3])):
                if all(hit[1] <= k[0] or k[1] <= hit[0] for k in kept):
                    kept.append(hit)
            return [f"{h[3]}={h[4]}" for h in sorted(kept)]

        return df.withColumn("variables", as_column(found, "array<string>", F.col(text)))


def _names(fields: str) -> list[str]:
    from pyspark.sql import types as T

    return T._parse_datatype_string(fields).names


def _scanning(scan: Scan, fields: str) -> type:
    names = _names(fields)

    class Scanning:
        def eval(self, text: str | None) -> Iterator[tuple]:
            for row in scan(text or ""):
                yield tuple(row.get(n) for n in names)

    return Scanning


def _folding(fold: Fold, fields: str) -> type:
    names = _names(fields)

    class Folding:
        """One for each partition of the table argument."""

        def __init__(self) -> None:
            self.rows: list[Row] = []

        def eval(self, row: Row) -> None:
            self.rows.append(row)

        def terminate(self) -> Iterator[tuple]:
            for found in fold(self.rows):
                yield tuple(found.get(n) for n in names)

    return Folding
