"""Merging translated Java methods into class skeletons."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltree import as_column

_TOKEN = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[{}]', re.S)
#: main, its words in camel case or after an underscore; not the letters inside another word (domain)
_MAIN = re.compile(r"^(?i:main)(?![a-z])|Main|(?i:_main)")
_METHOD = re.compile(r"(?:^|\n|(?<=[{}]))([ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:public|protected|private)?\s*(?:static\s+|final\s+|synchronized\s+)*[\w<>\[\], ?.]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?)\s*\{")


def closing(text: str, opening: int) -> int | None:
    """Where the brace at ``opening`` closes; strings and comments don't count."""
    level = 0
    for m in _TOKEN.finditer(text, opening):
        level += (m[0] == "{") - (m[0] == "}")
        if m[0] in "{}" and not level:
            return m.start()
    return None


def _spans(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, parameters, begin, end) of each method with a body."""
    at = 0
    while m := _METHOD.search(text, at):
        end = closing(text, m.end() - 1)
        if end is None or m[2] in ("if", "for", "while", "switch", "catch") or re.match(r"\s*(?:new|return|else)\b", m[1]):
            at = m.end()
            continue
        yield m[2], m[1][m[1].index("(", m.end(2) - m.start(1)) + 1 : m[1].rindex(")")], m.start(1), end + 1
        at = end + 1


def methods(text: str) -> Iterator[tuple[str, str]]:
    """(name, text) of each method with a body."""
    for name, _, begin, end in _spans(text):
        yield name, text[begin:end].strip("\n")


def _types(parameters: str) -> tuple[str, ...]:
    """Parameter types, without names, annotations and final."""
    flat = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b|\bthrows\b.*", " ", parameters, flags=re.S)
    out, level, part = [], 0, ""
    for c in flat + ",":
        level += (c == "<") - (c == ">")
        if c == "," and not level:
            out.append("".join(re.sub(r"\b\w+(\s*(?:\[\s*\]\s*)*)$", r"\1", part.strip()).split()))
            part = ""
        else:
            part += c
    return tuple(out)


def one_main(code: str) -> str:
    """The code with only the last of its main methods."""
    for _, _, begin, end in [x for x in _spans(code) if _MAIN.search(x[0])][-2::-1]:
        code = code[:begin].rstrip(" \t") + code[end:].lstrip()
    return code


def code_of(answer: str) -> str:
    """The fenced code of an answer, or all of it."""
    found = re.findall(r"```(?:java)?\s*\n(.*?)```", answer, re.S)
    return "\n".join(found) if found else answer


def merged(skeleton: str, answers: list[str], visibility: str | None = None, every: bool = False, mains: bool = False) -> str:
    """The skeleton with the answers' imports and methods, in order, overloads too.

    Of methods with the same name and parameter types, which no class can hold, the
    last stays, or all with ``every``. Of main methods, the skeleton's too, the last stays, or all with ``mains``.
    """
    imports, found = set(re.findall(r"^\s*import\s+([^;]+);", skeleton, re.M)), {}
    for answer in answers:
        code = code_of(answer)
        imports.update(re.findall(r"^\s*import\s+([^;]+);", code, re.M))
        for name, parameters, begin, end in _spans(code):
            text = code[begin:end].strip("\n")
            if visibility:
                text = re.sub(r"^(\s*(?:@\w+(?:\([^)]*\))?\s+)*)(?:public|protected|private)\s+", rf"\1{visibility} ", text, count=1)
            found[len(found) if every else (name, _types(parameters))] = text
    order = sorted(imports, key=lambda i: (0 if i.startswith("java.") else 1 if i.startswith("javax.") else 2, i))
    body = re.sub(r"^\s*import\s+[^;]+;[ \t]*\n?", "", skeleton, flags=re.M)
    package = re.match(r"\s*package\s+[^;]+;[ \t]*\n?", body)
    head, rest = (package[0].strip() + "\n\n", body[package.end() :]) if package else ("", body)
    opening = re.search(r"\b(?:class|interface|enum)\s+\w+[^{]*\{", rest)
    end = closing(rest, opening.end() - 1) if opening else None
    if end is None:
        whole = "\n\n".join([skeleton, *found.values()])
        return whole if mains else one_main(whole)
    whole = head + "".join(f"import {i};\n" for i in order) + ("\n" if order else "") + rest[:end].rstrip() + "\n\n" + "\n\n".join(found.values()) + "\n" + rest[end:]
    return whole if mains else one_main(whole)


PHASES = ("method", "class")


@dataclass(frozen=True)
class MergePlugin:
    """One change of a merge: of each method before it goes in, or of the whole class after; lower priorities first."""

    name: str
    phase: str
    change: Callable[[str], str]
    priority: int = 50


class MergePlugins:
    """Plugins by name; a name is registered once."""

    def __init__(self, *plugins: MergePlugin) -> None:
        self.held: dict[str, MergePlugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: MergePlugin) -> MergePlugins:
        if plugin.name in self.held or plugin.phase not in PHASES:
            raise ValueError(f"{plugin.name}: registered already, or no phase {plugin.phase}")
        self.held[plugin.name] = plugin
        return self

    def of(self, phase: str, names: list[str] | None = None) -> list[MergePlugin]:
        """Those of a phase, of some names if asked for, in order of priority; unknown names are left out."""
        return sorted((p for p in self.held.values() if p.phase == phase and (names is None or p.name in names)), key=lambda p: (p.priority, p.name))

    def applied(self, phase: str, text: str, names: list[str] | None = None) -> str:
        for p in self.of(phase, names):
            text = p.change(text)
        return text


_VISIBILITY = re.compile(r"^(\s*(?:@\w+(?:\([^)]*\))?\s+)*)(?:(?:public|protected|private)\s+)?")


def with_visibility(word: str) -> MergePlugin:
    """Each method with this visibility, whatever it had."""
    return MergePlugin("visibility", "method", lambda text: _VISIBILITY.sub(lambda m: f"{m[1]}{word} ", text, count=1), 30)


def with_annotation(annotation: str) -> MergePlugin:
    """An annotation on a line of its own above each method that does not have it."""

    def change(text: str) -> str:
        if re.search(re.escape(annotation) + r"\b", text):
            return text
        indent = re.match(r"\n*([ \t]*)", text)[1]
        return f"{indent}{annotation}\n{text}"

    return MergePlugin("category", "method", change, 50)


def single_main() -> MergePlugin:
    """Only the last of a class's main methods."""
    return MergePlugin("main_deduplicator", "class", one_main, 200)


def _by_class(translations: DataFrame, merge: Callable[[str, list[str]], str]) -> DataFrame:
    """class_id, text: ``merge`` over each class's first skeleton and its answers in order; classes come many in an Arrow batch."""
    answer = F.struct(F.col("ord").isNull().alias("last"), "ord", F.coalesce("llm_response", F.lit("")).alias("answer"), "skeleton")
    classes = translations.groupBy("class_id").agg(F.array_sort(F.collect_list(answer)).alias("a"))
    answers = F.transform("a", lambda x: x["answer"])
    return classes.select(F.col("class_id").cast("string").alias("class_id"), as_column(merge, "string", F.col("a")[0]["skeleton"], answers).alias("text"))


def merge_with(translations: DataFrame, plugins: MergePlugins, names: list[str] | None = None) -> DataFrame:
    """class_id, text: each class's skeleton with its answers' methods, all in order, changed by plugins."""

    def one(skeleton: str, given: list[str]) -> str:
        answers = ["\n\n".join(plugins.applied("method", text, names) for _, text in methods(code_of(a))) for a in given]
        imports = ["\n".join(re.findall(r"^\s*import\s+[^;]+;", code_of(a), re.M)) for a in given]
        return plugins.applied("class", merged(skeleton, [f"{i}\n{a}" for i, a in zip(imports, answers)], every=True, mains=True), names)

    return _by_class(translations, one)


def merge_classes(translations: DataFrame, visibility: str | None = None, every: bool = False) -> DataFrame:
    """class_id, text: each class's skeleton with its answers (skeleton, llm_response, ord) in order."""
    return _by_class(translations, lambda skeleton, answers: merged(skeleton, answers, visibility, every))
