"""Node and edge relations: lineage by name ladders, closures, call chains, merges, lookups."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import spread, stored

from ..functions.rewrite import camel

#: rungs of name matching, best first: (rule, confidence, key of the left name, key of the right name)
PREFIXES = ("H_", "h_", "W_", "w_", "i_", "o_")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^(?:" + "|".join(PREFIXES) + ")", "")


RUNGS: list[tuple[str, float, object, object]] = [
    ("exact", 1.0, lambda c: c, lambda c: c),
    ("lower", 0.95, F.lower, F.lower),
    ("stripped_camel", 0.9, lambda c: camel(_stripped(c)), lambda c: c),
    ("stripped", 0.9, _stripped, lambda c: c),
    ("stripped_lower", 0.85, lambda c: F.lower(_stripped(c)), F.lower),
]


def name_links(left: DataFrame, right: DataFrame, link_type: str, *same: str) -> DataFrame:
    """(source_id, target_id, link_type, confidence, rule): pairs of names that some rung makes equal.

    Inputs have id and name (and the columns of ``same``, which must agree). Each
    rung is an equality join on derived keys; a pair keeps its best rung, so no
    pair of names is ever compared that does not match.
    """
    keys = lambda df, side, which: spread(df).select(F.col("id").alias(f"{side}_id"), *same, F.explode(F.array(*(F.struct(F.lit(k).alias("rung"), rung[which](F.col("name")).alias("key")) for k, rung in enumerate(RUNGS)))).alias("_k")).select(f"{side}_id", *same, "_k.*")
    # a small file may hold many names, each with several keys: no side is sent to all tasks whole
    matched = keys(left, "source", 2).hint("merge").join(keys(right, "target", 3), ["rung", "key", *same]).groupBy("source_id", "target_id").agg(F.min("rung").alias("rung"))
    rules = F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("confidence")) for r in RUNGS))
    best = rules[F.col("rung")]
    return matched.select("source_id", "target_id", F.lit(link_type).alias("link_type"), best["confidence"].alias("confidence"), best["rule"].alias("rule"))


def closure(edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """node, depth: all that is reached from the seeds, each once at its least depth; nothing is followed beyond ``stop`` nodes."""
    rooted = reach(edges, seeds.select(F.lit(0).alias("root"), "node").distinct(), None, stop)
    return rooted.select("node", "depth")


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """root, node, depth: all that is reached from each (root, node), each once at its least depth, up to ``most`` hops.

    Frontiers grow by joins until one is empty, and what is already reached is
    left out, so cycles end and no path is walked twice. Each frontier is stored,
    and now and then what is reached, so that plans don't grow with the depth.
    """
    reached = stored(starts.select("root", "node", F.lit(0).alias("depth")).distinct())
    frontier = reached
    for depth in itertools.count(1):
        if most is not None and depth > most:
            return reached
        going = frontier if stop is None else frontier.join(stop.select("node"), "node", "left_anti")
        new = going.join(edges, F.col("node") == F.col("source_id")).select("root", F.col("target_id").alias("node")).distinct()
        frontier = stored(new.join(reached.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier)
        if depth % 16 == 0:
            reached = stored(reached)


def walked(first: DataFrame, following: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a recursive query, repeats kept: the first ones, and what each level's rows lead to until a level is empty.

    Each level is stored, and now and then all of them as one, so neither the
    number of rows nor that of levels has a limit.
    """
    level = stored(first)
    rows = level
    for depth in itertools.count(1):
        level = stored(following(level))
        if level.isEmpty():
            return rows
        rows = rows.union(level)
        if depth % 16 == 0:
            rows = stored(rows)


def call_chains(edges: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """root, node, depth: callees up to ``most`` calls away at their least depth."""
    return reach(edges, seeds.select(F.col("node").alias("root"), "node"), most)


def neighbours(edges: DataFrame, nodes: DataFrame, up: bool) -> DataFrame:
    """One hop up or down from the nodes, repeats kept."""
    at, other = ("target_id", "source_id") if up else ("source_id", "target_id")
    return edges.join(nodes.select(F.col("node").alias(at)), at).select(F.col(at).alias("node"), F.col(other).alias("neighbour"))


def externals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets that are no known node."""
    return edges.select(F.col("target_id").alias("node")).distinct().join(nodes.select(F.col("id").alias("node")), "node", "left_anti")


def merged(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes by id, those of ``b`` winning; edges of both, repeats kept."""
    both = a[0].withColumn("_o", F.lit(0)).unionByName(b[0].withColumn("_o", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_o"]
    nodes = both.groupBy("id").agg(F.max_by(F.struct(*columns), "_o").alias("n")).select("n.*")
    return nodes, a[1].unionByName(b[1])


def type_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def common_targets(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Targets that every one of the sources has (relational division by counts)."""
    wanted = sources.select(F.col("node").alias("source_id")).distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("total"))
    held = edges.join(wanted, "source_id", "left_semi").groupBy("target_id").agg(F.countDistinct("source_id").alias("n"))
    return held.join(F.broadcast(total), F.col("n") == F.col("total")).select("target_id")


def resolved_includes(includes: DataFrame, listing: DataFrame, search: list[str]) -> DataFrame:
    """Each include (source_dir, name) with the first existing path: its own folder, then the search paths in order."""
    candidates = includes.withColumn("_c", F.concat(F.array(F.concat("source_dir", F.lit("/"), "name")), F.array(*(F.concat(F.lit(p + "/"), F.col("name")) for p in search))))
    placed = candidates.select(*includes.columns, F.posexplode("_c").alias("_order", "path"))
    hits = placed.join(listing.select("path"), "path", "left_semi").groupBy(*includes.columns).agg(F.min_by("path", "_order").alias("path"))
    return includes.join(hits, includes.columns, "left")


def word_edges(assignments: DataFrame, variables: DataFrame) -> DataFrame:
    """(source, target) data-flow edges: known variables that occur as words in an assignment's expression."""
    words = assignments.select("file_id", F.col("target"), F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"\b([A-Za-z_]\w*)"), F.lit(1)))).alias("name"))
    return words.join(variables.select("file_id", "name").distinct(), ["file_id", "name"]).select("file_id", F.col("name").alias("source"), "target").where("source <> target")


#: issues of one word that meet others in one task; longer lists meet in blocks
BLOCK = 1024


def similar_issues(issues: DataFrame, least: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(a, b, overlap): issues (id, text; ids are unique) whose word sets overlap by more than ``least`` of the smaller set.

    A pair that passes shares one of the smaller set's rarest words: so many
    that the rest alone could not pass. Only those words are looked up, so a
    word that is in all issues joins nothing but sets made of such words. A pair
    counts at the first of them that it shares and is scored there, so pairs are
    never gathered or compared with each other. Issues that share a word meet in
    blocks, so a frequent word's pairs spread over all tasks.
    """
    words = issues.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != ""))).alias("word"))
    words = stored(spread(words))
    known = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("word_id", F.monotonically_increasing_id()))
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("df", "word_id"))), lambda w: w["word_id"])
    sets = words.join(known, "word").groupBy("id").agg(rarest.alias("words")).withColumn("size", F.size("words"))
    sets = stored(sets)
    looked = sets.select("id", "size", "words", F.posexplode(F.slice("words", 1, F.col("size") - F.floor(F.col("size") * least).cast("int"))).alias("at", "word_id"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    met = looked.groupBy("word_id").agg(F.count(F.lit(1)).alias("n")).join(known, "word_id").select("word_id", blocks("n").alias("rows"), blocks("df").alias("columns"))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    x = looked.join(met, "word_id").select("word_id", own("rows").alias("row"), all_of("columns").alias("column"), F.struct("id", "size", "words", "at").alias("x"))
    y = sets.select("id", "size", "words", F.explode("words").alias("word_id")).join(met, "word_id").select("word_id", all_of("rows").alias("row"), own("columns").alias("column"), F.struct("id", "size", "words").alias("y"))
    smaller = F.expr("x.id <> y.id and (x.size < y.size or (x.size = y.size and x.id < y.id))")
    first = ~F.arrays_overlap(F.slice("x.words", F.lit(1), F.col("x.at")), F.col("y.words"))
    overlap = F.size(F.array_intersect("x.words", "y.words")) / F.col("x.size")
    pairs = x.hint("merge").join(y, ["word_id", "row", "column"]).where(smaller & first)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), overlap.alias("overlap")).where(F.col("overlap") > least)
