"""Program graphs: resolution of headers, mutually dependent closures, data flow, members."""

import random

from pyspark.sql import functions as F

from sourceloom.operators import program_graph as pg
from sourceloom.operators.scanner import assignments, field_uses


def test_paths_and_resolution(spark):
    paths = ["a/./b/../c.h", "/x//y/../../z.h", "../up/../q.h", "plain.h", "a/.."]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(pg.normal_path(F.col("p")).alias("n")).collect()
    assert [r.n for r in rows] == ["a/c.h", "/z.h", "../q.h", "plain.h", ""]
    listing = spark.createDataFrame([("src/own.h",), ("inc/own.h",), ("inc/both.h",), ("lib/both.h",), ("top.h",)], "path string")
    includes = spark.createDataFrame([("src/a.c", "own.h"), ("src/a.c", "both.h"), ("src/a.c", "../top.h"), ("src/a.c", "none.h"), ("top.c", "top.h")], "path string, name string")
    got = {(r.path, r.name): r.target for r in pg.resolved(includes, listing, ["lib", "inc"]).collect()}
    assert got == {("src/a.c", "own.h"): "src/own.h", ("src/a.c", "both.h"): "lib/both.h", ("src/a.c", "../top.h"): "top.h", ("src/a.c", "none.h"): None, ("top.c", "top.h"): "top.h"}


def test_mutual_closure_against_a_plain_one(spark):
    rng = random.Random(3)
    for follow in (True, False):
        files = [f"d/{k}.c" for k in range(14)]
        defines = {(f, f"f{rng.randrange(10)}") for f in files for _ in range(2)}
        includes = {(rng.choice(files), rng.choice(files)) for _ in range(9)}
        calls = {(f, n, f"f{rng.randrange(12)}") for f, n in defines for _ in range(rng.randrange(3))}
        told = {
            "includes": spark.createDataFrame([(a, b, b) for a, b in includes], "path string, name string, target string"),
            "functions": spark.createDataFrame(list(defines), "path string, name string"),
            "calls": spark.createDataFrame(list(calls), "path string, caller string, callee string"),
        }
        got = pg.programs(told, spark.createDataFrame([(files[0],), (files[1],)], "path string"), follow)
        reached, live = {files[0], files[1]}, set()
        while True:
            before = len(reached), len(live)
            reached |= {b for a, b in includes if a in reached}
            live |= {(f, n) for f, n in defines if f in files[:2]}
            targets = {(g, m) for f, n, m in calls if (f, n) in live for g, x in defines if x == m}
            if follow:
                reached |= {g for g, _ in targets}
            live |= {(g, m) for g, m in targets if g in reached}
            if before == (len(reached), len(live)):
                break
        assert {r.path for r in got["file"].collect()} == reached
        assert {(r.path, r.name) for r in got["live"].collect()} == live


SOURCES = {
    "src/main.c": '#include "one.h"\n#include <gone.h>\nint total;\nint helper(int x) { return x; }\nint main(void) {\n  int n;\n  rec_t r;\n  n = total = helper(3) + LIMIT;\n  if (n == total) r.count = n;\n  p->next = 0;\n  shared(n);\n}\n',
    "inc/one.h": '#include "two.h"\n#define LIMIT 3\n',
    "inc/two.h": '#include "one.h"\nint deep;\nint shared(int y) {\n  int z;\n  z = deep;\n  return z;\n}\n',
    "src/other.c": "int unused(void) { return 0; }\n",
}


def test_graph_through_two_levels_of_headers(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    nodes, edges = pg.program_graph(files, spark.createDataFrame([("src/main.c",)], "path string"), ["inc"])
    found = {(r.source_id, r.target_id, r.kind) for r in edges.collect()}
    main, two = "src/main.c", "inc/two.h"
    assert found == {
        (f"file:{main}", "file:inc/one.h", "INCLUDES"), (f"file:{main}", "header:gone.h", "INCLUDES"), ("file:inc/one.h", f"file:{two}", "INCLUDES"), (f"file:{two}", "file:inc/one.h", "INCLUDES"),
        (f"file:{main}", f"function:{main}::helper", "CONTAINS"), (f"file:{main}", f"function:{main}::main", "CONTAINS"), (f"file:{two}", f"function:{two}::shared", "CONTAINS"),
        (f"function:{main}::main", f"function:{main}::helper", "CALLS"), (f"function:{main}::main", f"function:{two}::shared", "CALLS"),
        (f"variable:{main}::r", f"member:{main}::r.count", "FIELD_WRITE"),
        (f"variable:{two}::deep", f"variable:{two}::z", "DATA_FLOW"),
    }
    ids = {r.id for r in nodes.collect()}
    assert {x for a, b, _ in found for x in (a, b)} <= ids and not any("other.c" in i for i in ids)
    assert len(ids) == nodes.count()


def test_assignments_and_members():
    text = 'int a = b + 1; /* c = d; */ char *s = "e = f;";\nx[i] = y = z == 2; p->q = r; u += v; if (m <= n) { w = (k != 3); }\nEXEC SQL UPDATE t SET g = h;'
    assert [(a["target"], a["expression"]) for a in assignments(text)] == [("a", "b + 1"), ("s", ""), ("x", "z == 2"), ("y", "z == 2"), ("u", "v"), ("w", "(k != 3)")]
    assert [(f["struct"], f["field"], f["access"], f["is_pointer"]) for f in field_uses("p->q = r.x; if (a.b == c[1].d) /* e.f */ s = \"g.h\";")] == [("p", "q", "write", True), ("r", "x", "read", False), ("a", "b", "read", False), ("c", "d", "read", False)]


def test_scans_use_all_cores(spark, monkeypatch):
    """A table in one part is scanned in many; what only reached files tell is looked for in those alone."""
    from sourceloom.operators import program_graph, scanner

    one = spark.createDataFrame([(f"f{k}.c", f"int f{k}(void) {{\n  int a;\n  a = {k};\n}}\n") for k in range(50)], "path string, content string").coalesce(1)
    found = scanner.scan_files(one, "c", "path")
    assert found.rdd.getNumPartitions() > 1 and found.where("kind = 'function'").count() == 50
    scanned = {}
    plain = program_graph.scan_files
    monkeypatch.setattr(program_graph, "scan_files", lambda files, what, key: scanned.setdefault(what, files.count()) and plain(files, what, key))
    program_graph.program_graph(one, one.where("path = 'f7.c'").select("path"))
    assert scanned == {"c": 50, "directive": 50, "assignment": 1, "field": 1}
