"""The property graph of programs: calls, includes, data flow and member uses, through all files that the roots lead to.

Which files belong to a program and which functions are alive depend on each
other: an include brings a file, a live call brings the file that defines its
target, and a function is alive once a live one calls it and its file is there.
``fixpoint`` evaluates such relations together, and each round joins only what the
last one added.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .graphs import word_edges
from .scanner import scan_files

Relations = dict[str, DataFrame]
#: a rule: from what a relation gained, and all relations so far, rows of another
Rule = tuple[str, str, Callable[[DataFrame, Relations], DataFrame]]
#: rounds after which what was gained is stored as one again, so that plans stay short
TOGETHER = 12


def fixpoint(seeds: Relations, rules: list[Rule]) -> Relations:
    """The least relations that hold the seeds and obey the rules (head, body, rule); all are sets.

    A rule over two of the relations is given once for each: with what the one
    gained and all of the other. ``rule`` sees all that was there before the round.
    """
    total = {name: stored(df.distinct()) for name, df in seeds.items()}
    gained = dict(total)
    for round in itertools.count(1):
        fresh = {}
        for head in total:
            made = [rule(gained[body], total).select(*total[head].columns) for h, body, rule in rules if h == head and body in gained]
            if made:
                new = reduce(DataFrame.unionByName, made).distinct()
                new = stored(new.join(total[head], total[head].columns, "left_anti"))
                if not new.isEmpty():
                    fresh[head] = new
        if not fresh:
            return total
        for head, new in fresh.items():
            total[head] = total[head].unionByName(new)
            if round % TOGETHER == 0:
                total[head] = stored(total[head])
        gained = fresh


def normal_path(c: Column) -> Column:
    """A path without ``.`` and ``..`` steps, as far as it names what they lead back over."""
    none = F.expr("cast(array() as array<string>)")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))
    return F.concat(F.when(F.startswith(c, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(F.split(c, "/"), none, step), "/"))


def resolved(includes: DataFrame, listing: DataFrame, search: list[str]) -> DataFrame:
    """Includes (path, name, ...) with ``target``: the first listed path of their own folder, then of the search folders; null if none."""
    own = F.regexp_extract("path", r"^(.*/)", 1)
    places = F.transform(F.array(own, *(F.lit(f"{p}/") for p in search)), lambda p: normal_path(F.concat(p, F.col("name"))))
    asked = includes.select("path", "name").distinct().select("path", "name", F.posexplode(places).alias("place", "target"))
    found = asked.join(listing.select(F.col("path").alias("target")).distinct(), "target", "left_semi").groupBy("path", "name").agg(F.min_by("target", "place").alias("target"))
    return includes.join(found, ["path", "name"], "left")


def facts(files: DataFrame, search: list[str] = ()) -> Relations:
    """What each file (path, content) says: includes, functions, calls, variables; stored."""
    scan = lambda what: scan_files(files, what, "path")
    c = stored(scan("c").select("path", "kind", "name", "parent", "line_start"))
    includes = scan("directive").where("kind = 'include'").select("path", "name", F.col("value").alias("kind"))
    return {
        "includes": stored(resolved(includes, files, list(search)).distinct()),
        "functions": c.where("kind = 'function'").select("path", "name"),
        "calls": c.where("kind = 'function_call'").select("path", F.col("parent").alias("caller"), F.col("name").alias("callee")).distinct(),
        "variables": c.where("kind = 'variable'").select("path", "name").distinct(),
    }


def programs(told: Relations, roots: DataFrame, follow_calls: bool = True) -> Relations:
    """file (path) and live (path, name): what the root files (path) lead to.

    Without ``follow_calls`` only includes bring files; system headers are files
    like others where they are listed.
    """
    includes = told["includes"].where("target is not null").select("path", F.col("target"))
    functions = stored(told["functions"].distinct())
    calls = stored(told["calls"])
    # a call from one file to each file that defines its target
    targets = stored(calls.join(functions.select(F.col("name").alias("callee"), F.col("path").alias("target")), "callee").select("path", F.col("caller").alias("name"), "target", "callee"))
    first = roots.select("path").distinct()
    brought: Callable[[DataFrame, Relations], DataFrame] = lambda new, all: new.join(targets, ["path", "name"]).select(F.col("target").alias("path"))
    called = lambda live: live.join(targets, ["path", "name"]).select(F.col("target").alias("path"), F.col("callee").alias("name"))
    rules: list[Rule] = [
        ("file", "file", lambda new, all: new.join(includes, "path").select(F.col("target").alias("path"))),
        ("live", "live", lambda new, all: called(new).join(all["file"], "path", "left_semi")),
        ("live", "file", lambda new, all: called(all["live"]).join(new, "path", "left_semi")),
    ]
    if follow_calls:
        rules.append(("file", "live", brought))
    return fixpoint({"file": first, "live": functions.join(first, "path", "left_semi")}, rules)


def program_graph(files: DataFrame, roots: DataFrame, search: list[str] = (), follow_calls: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name, path) and edges (source_id, target_id, kind) of the files that the roots lead to.

    Edges: INCLUDES to files, or to headers by name where no file is found; CONTAINS
    from files to functions; CALLS to functions of the same file, else of any file
    of the graph, else to an external name; DATA_FLOW from a known variable to the
    variable that an expression with it sets; FIELD_READ and FIELD_WRITE from
    a known variable to its members.
    """
    told = facts(files, search)
    reached = programs(told, roots, follow_calls)["file"]
    within = {k: df.join(reached, "path", "left_semi") for k, df in told.items()}
    # what no other file's fate depends on is looked for in the reached files only
    own_files = files.join(reached, "path", "left_semi")
    within |= {"assignments": scan_files(own_files, "assignment", "path"), "members": scan_files(own_files, "field", "path")}
    id = lambda kind, *parts: F.concat(F.lit(f"{kind}:"), *(x for k, p in enumerate(parts) for x in (([F.lit("::")] if k else []) + [F.col(p)])))
    functions, calls = within["functions"].distinct(), within["calls"]
    own = calls.join(functions.select("path", F.col("name").alias("callee")), ["path", "callee"]).withColumn("target", F.col("path"))
    elsewhere = calls.join(own.select("path", "callee").distinct(), ["path", "callee"], "left_anti").join(functions.select(F.col("name").alias("callee"), F.col("path").alias("target")), "callee", "left")
    targeted = own.unionByName(elsewhere)
    target = F.when(F.col("target").isNull(), id("external", "callee")).otherwise(id("function", "target", "callee"))
    flows = word_edges(within["assignments"].select(F.col("path").alias("file_id"), "target", "expression"), within["variables"].withColumnRenamed("path", "file_id")).withColumnRenamed("file_id", "path")
    flows = flows.join(within["variables"].withColumnRenamed("name", "target"), ["path", "target"], "left_semi").distinct()
    members = within["members"].join(within["variables"].withColumnRenamed("name", "struct"), ["path", "struct"], "left_semi").select("path", "struct", "access", F.concat("struct", F.lit("."), "field").alias("member")).distinct()
    edge = lambda df, source, to, kind: df.select(source.alias("source_id"), to.alias("target_id"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"))
    edges = (
        edge(within["includes"], id("file", "path"), F.when(F.col("target").isNull(), id("header", "name")).otherwise(id("file", "target")), "INCLUDES")
        .unionByName(edge(functions, id("file", "path"), id("function", "path", "name"), "CONTAINS"))
        .unionByName(edge(targeted, id("function", "path", "caller"), target, "CALLS"))
        .unionByName(edge(flows, id("variable", "path", "source"), id("variable", "path", "target"), "DATA_FLOW"))
        .unionByName(edge(members, id("variable", "path", "struct"), id("member", "path", "member"), F.concat(F.lit("FIELD_"), F.upper("access"))))
        .distinct()
    )
    none = F.lit(None).cast("string")
    node = lambda df, i, kind, name, path: df.select(i.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"))
    path = F.col("path")
    nodes = (
        node(reached, id("file", "path"), "file", F.regexp_extract("path", "([^/]*)$", 1), path)
        .unionByName(node(within["includes"].where("target is null"), id("header", "name"), "header", F.col("name"), none))
        .unionByName(node(functions, id("function", "path", "name"), "function", F.col("name"), path))
        .unionByName(node(targeted.where("target is null"), id("external", "callee"), "external", F.col("callee"), none))
        .unionByName(node(within["variables"], id("variable", "path", "name"), "variable", F.col("name"), path))
        .unionByName(node(members, id("member", "path", "member"), "member", F.col("member"), path))
        .distinct()
    )
    return nodes, edges
