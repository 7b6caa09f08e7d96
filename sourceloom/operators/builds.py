"""Graphs and reports that are built from whole files: dependencies, header pipelines, links, verification stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .graphs import closure
from .scanner import scan_files


def dependency_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind: file, system or external) and include edges (source_id, target_id, kind) of files (file_id, content)."""
    includes = scan_files(files, "directive").where("kind = 'include'").select(F.col("file_id").cast("string").alias("source_id"), F.col("name").alias("target_id"), F.col("value").alias("kind"))
    known = files.select(F.col("file_id").cast("string").alias("id"), F.lit("file").alias("kind"))
    targets = includes.groupBy(F.col("target_id").alias("id")).agg(F.when(F.bool_and(F.col("kind") == "system"), "system").otherwise("external").alias("kind"))
    return known.unionByName(targets.join(known.select("id"), "id", "left_anti")), includes


def header_pipeline(files: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id, depth, header_type, macros: the files reached from the roots (node) by includes, but for system ones, typed, with their macros' number."""
    _, edges = dependency_graph(files)
    reached = closure(edges.where("kind <> 'system'"), roots)
    macros = scan_files(files, "directive").where("kind = 'macro'").groupBy("file_id").agg(F.count(F.lit(1)).alias("macros"))
    typed = files.select("file_id", rules.header_type(F.col("content")).alias("header_type"))
    return reached.withColumnRenamed("node", "file_id").join(typed, "file_id").join(macros, "file_id", "left").select("file_id", "depth", "header_type", F.coalesce("macros", F.lit(0)).cast("long").alias("macros"))


def lineage_nodes(*loads: tuple[str, DataFrame]) -> DataFrame:
    """id, kind, name: the nodes of several loads (kind, rows with id and name); of an id that comes twice the first load stays."""
    rows = reduce(DataFrame.unionByName, (df.select(F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name"), F.lit(k).alias("load")) for k, (kind, df) in enumerate(loads)))
    return rows.groupBy("id").agg(F.min_by(F.struct("kind", "name"), "load").alias("n")).select("id", "n.kind", "n.name")


def call_links(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """source_id, target_id: calls (parent, name) of functions that are known in both places."""
    known = functions.select(F.col("name").alias("_n")).distinct()
    return calls.join(known, F.col("parent") == F.col("_n"), "left_semi").join(known, F.col("name") == F.col("_n"), "left_semi").select(F.col("parent").alias("source_id"), F.col("name").alias("target_id")).distinct()


def include_links(includes: DataFrame, programs: DataFrame) -> DataFrame:
    """source_id, target_id, link: each include of a program's file, and the program that holds the file."""
    down = includes.select("source_id", "target_id", F.lit("INCLUDES").alias("link"))
    return down.unionByName(programs.select(F.col("program").alias("source_id"), F.col("file_id").cast("string").alias("target_id"), F.lit("CONTAINS").alias("link")))


def macro_uses(macros: DataFrame, variables: DataFrame) -> DataFrame:
    """macro, variable: variables whose names are words of a macro's body."""
    words = macros.select(F.col("name").alias("macro"), F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"\b([A-Za-z_]\w*)"), F.lit(1)))).alias("variable"))
    return words.join(variables.select(F.col("name").alias("variable")).distinct(), "variable", "left_semi").select("macro", "variable").distinct()


def promoted_issues(issues: DataFrame, least: int = 3) -> DataFrame:
    """text, n: issues that came up ``least`` times, for the checklist."""
    return issues.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def element_checks(elements: DataFrame) -> DataFrame:
    """file_id, check, failed: elements (file_id, line_start, line_end, sql_id, sql_text) with wrong line ranges, or without a field."""
    wrong = (F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start"))
    missing = F.col("sql_id").isNull() | (F.coalesce("sql_text", F.lit("")) == "")
    counted = elements.groupBy("file_id").agg(F.count_if(wrong).alias("line_ranges"), F.count_if(missing).alias("required_fields"))
    return counted.select("file_id", F.expr("stack(2, 'line_ranges', line_ranges, 'required_fields', required_fields) as (check, failed)"))


def struct_checks(files: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, in_text, extracted: structs that a text begins against those extracted."""
    counted = files.select("file_id", F.regexp_count("content", F.lit(r"\bstruct\s+\w*\s*\{")).cast("long").alias("in_text"))
    return counted.join(found.groupBy("file_id").agg(F.count(F.lit(1)).alias("extracted")), "file_id", "left").fillna(0, ["extracted"])


def class_checks(texts: DataFrame, name: Column) -> DataFrame:
    """The rows with ``has_class``: whether the text declares the class."""
    return texts.withColumn("has_class", F.regexp_like("text", F.concat(F.lit(r"\bclass\s+"), name, F.lit(r"\b"))))


PHASES = ("pre", "verify", "post")


@dataclass(frozen=True)
class Stage:
    """One check: rows in, (check, status, message) columns out; lower priorities run first within a phase."""

    name: str
    phase: str
    status: Callable[[DataFrame], Column] | None
    priority: int = 50
    message: Callable[[DataFrame], Column] | None = None


class Verifier:
    """Checks by phase and priority, over all rows at once; a stage without a rule (an outside model that isn't there) is SKIPPED."""

    def __init__(self, *stages: Stage) -> None:
        self.stages: list[Stage] = []
        for s in stages:
            self.register(s)

    def register(self, stage: Stage) -> Verifier:
        if stage.phase not in PHASES:
            raise ValueError(stage.phase)
        self.stages = sorted([s for s in self.stages if s.name != stage.name] + [stage], key=lambda s: (PHASES.index(s.phase), s.priority, s.name))
        return self

    def run(self, rows: DataFrame) -> DataFrame:
        """The rows' columns with phase, ordinal, check, status and message; one row for each stage."""
        told = [
            F.struct(
                F.lit(s.phase).alias("phase"),
                F.lit(k).alias("ordinal"),
                F.lit(s.name).alias("check"),
                (s.status(rows) if s.status else F.lit("SKIPPED")).alias("status"),
                (s.message(rows) if s.message else F.lit("")).alias("message"),
            )
            for k, s in enumerate(self.stages)
        ]
        return rows.select(*rows.columns, F.inline(F.array(*told)))
