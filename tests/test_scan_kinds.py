"""Scans that look only for what is asked: the same elements, no other work."""

import random

import pytest

from sourceloom.operators import scanner
from sourceloom.plans import inventory, units
from sourceloom.plans.queries import QUERIES

ODD = ["EXEC SQL", " ", "\n", "\n", " \t", "#if X {", '"', "'", "\\", "\\\n", "/*", "*/", "//", "{", "}", "(", ")", ";", "int a;", "char h[20] = 1;", "f", "g(s)", "struct", "typedef", "void fn(void) {", "if (x) {", "struct s {", "} z;", "EXEC SQL BEGIN DECLARE SECTION;"]
WHOLE = ['void f%d(int a) {\n  int b; g(a); /* } */ s = "{";\n#if X {\n  if (a) { h(); }\n}\n', "struct s%d { int a[2]; } q;\n", "EXEC SQL SELECT a FROM b WHERE c = 'x;%d';\n", '#define M%d "y\n', "int v%d = 3;\n", "// it's {%d\n"]


def _texts():
    rng = random.Random(3)
    for k in range(600):
        yield "".join(rng.choice(WHOLE) % k if rng.random() < k / 600 else rng.choice(ODD) for k in range(rng.randrange(1, 30)))


def _elements(text, *kinds):
    try:
        return list(scanner.c_elements(text, *kinds))
    except IndexError:  # a struct at the end of a text
        return None


def test_kinds_are_those_of_the_whole_scan():
    paired = 0
    for text in _texts():
        every = _elements(text)
        paired += scanner._outer_tokens(text) is not None
        for kinds in (("variable",), ("function",), ("function", "struct"), ("function_call",)) if every is not None else ():
            assert _elements(text, kinds) == [e for e in every if e["kind"] in kinds], text
        if every is not None:
            found = list(scanner.outline(text))
            assert [(e["start"], e["end"]) for e in found if e["kind"] == "sql"] == [(b["start"], b["end"]) for b in scanner.sql_blocks(text)]
            assert [e["raw"] for e in found if e["kind"] == "function"] == [e["raw"] for e in every if e["kind"] == "function"]
    assert 100 < paired < 500  # both ways through a text are taken


def test_blocks_and_directives_by_all_tokens():
    """What is hidden, and which lines are directives, as all tokens tell."""
    for text in _texts():
        tokens = list(scanner.TOKEN.finditer(text))
        hidden = [(m.start(), m.end()) for m in tokens if m.lastgroup == "comment" or m.lastgroup == "string" and m[0][0] == '"']
        assert not any(a <= b["start"] < e for b in scanner.sql_blocks(text) for a, e in hidden), text
        macros = [m[0].strip() for m in tokens if m.lastgroup == "directive" and scanner._DEFINE.match(m[0].strip())]
        assert len([d for d in scanner.directives(text) if d["kind"] == "macro"]) == len(macros), text


def test_only_named_fields_are_made(spark):
    files = spark.createDataFrame([("a", "int x;\nvoid f(void) {\n  g();\n}\n"), ("b", None)], "file_id string, content string")
    found = scanner.scan_files(files, "c", fields=("name",), kinds=("variable",))
    assert found.columns == ["file_id", "name"] and [tuple(r) for r in found.collect()] == [("a", "x")]
    assert scanner.scan_files(files, "c", fields=("seq", "kind")).columns == ["file_id", "seq", "kind"]


@pytest.mark.parametrize("place, name", [(inventory, "j4_variables_in_sections"), (inventory, "j23_macro_uses"), (units, "s12_elements_by_type"), (units, "s20_descriptors")])
def test_queries_ask_for_what_they_use(spark, sf_dir, monkeypatch, place, name):
    asked, plain = {}, scanner.scan_files
    monkeypatch.setattr(place, "scan_files", lambda files, what, **more: asked.setdefault(what, plain(files, what, **more)))
    QUERIES[name](spark, sf_dir).count()
    for what in {"c", "section", "header"} & set(asked):
        assert not {"seq", "raw", "array_size"} & set(asked[what].columns)
    if name in ("j4_variables_in_sections", "j23_macro_uses"):
        monkeypatch.setattr(scanner, "_nested_elements", None)  # variables need no tokens
        assert list(scanner.c_elements("int a;\nvoid f() { g(); }", ("variable",)))[0]["name"] == "a"


def test_spliced_files_are_scanned_once(spark, sf_dir):
    plan = QUERIES["n17_spliced_markers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
