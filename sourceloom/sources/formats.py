"""Formats of our own for ``spark.read`` and ``df.write``, as Python data sources.

Readers: ``conversion_pairs``, ``yaml_checklist`` and ``source_tree`` deal out the files under
a path by size, and give a row with an ``error`` for a file that cannot be read,
instead of failing. The driver keeps folders, not files: it looks at one folder after the
other, and tasks list the folders, or shares of large ones, that they get. Writer:
``text_files`` writes a file for each row; tasks write to a folder aside, with a sorted list of
names, and only the commit moves what the tasks that count have written to its place, so a
repeated or failed task leaves nothing; it merges the lists, a little of each at a time.

Paths are opened by pyarrow (local, HDFS, S3 and the like); for a store that only
Spark opens use the functions of ``files``. ``register`` makes the formats known.
"""

from __future__ import annotations

import contextlib
import heapq
import itertools
import json
import os
import posixpath
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

#: bytes of files, and files, that one task reads
PART_BYTES, PART_FILES = 32 << 20, 20_000
#: bytes of a task's list of names that the commit holds at a time, names that it looks at at once, and files that it moves at once
LIST_BYTES, LOOK_AT, MOVERS = 1 << 14, 1000, 16
#: the list of names in a task's folder
NAMES = "names"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name, with or without a scheme."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def entries(system: fs.FileSystem, folder: str, sizes: bool = True) -> Iterator[tuple[str, bool, int]]:
    """path, whether it is a folder, and size of what lies in a folder; of a local one without a list of all."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                yield info.path, info.type == fs.FileType.Directory, info.size or 0
        return
    with os.scandir(folder) as found:
        for x in found:
            if x.is_dir() or x.is_file():
                yield posixpath.join(folder, x.name), x.is_dir(), x.stat().st_size if sizes and not x.is_dir() else 0


def share_of(path: str, shares: int) -> int:
    """Which of a folder's shares a file is in."""
    return zlib.crc32(posixpath.basename(path).encode("utf-8", "surrogateescape")) % shares


@dataclass
class Files(InputPartition):
    #: files that are named themselves
    paths: list[str] = field(default_factory=list)
    #: (folder, which share of its own files, of how many)
    folders: list[tuple[str, int, int]] = field(default_factory=list)


def loaded(text: str) -> object:
    """A YAML text's value, by the library's parser in C where there is one; what that refuses is left to the plain one."""
    import yaml

    if yaml.__with_libyaml__:
        with contextlib.suppress(yaml.YAMLError):
            return yaml.load(text, yaml.CSafeLoader)
    return yaml.safe_load(text)


def pairs_of(text: str) -> Iterator[tuple]:
    """idx, sql, parsed_sql, metadata of a YAML text's pairs; items that are none are left out, but keep their number."""
    items = loaded(text) or []
    for idx, item in enumerate(items if isinstance(items, list) else [items]):
        if isinstance(item, dict) and item.get("sql") is not None and item.get("parsed_sql") is not None:
            yield idx, str(item["sql"]).strip(), str(item["parsed_sql"]).strip(), {str(k): str(v) for k, v in item.items() if k not in ("sql", "parsed_sql")}


def checks_of(text: str, key: str) -> Iterator[tuple]:
    """ordinal, name, item of the list or mapping that lies under a dotted key, however deep; a mapping's items carry its keys."""
    import yaml

    found = yaml.safe_load(text)
    for part in key.split("."):
        found = found.get(part) if isinstance(found, dict) else None
    named = list(found.items()) if isinstance(found, dict) else [(None, x) for x in found] if isinstance(found, list) else []
    for ordinal, (name, item) in enumerate(named):
        if isinstance(item, dict):
            name, item = item.get("name", name), item.get("check", item.get("description", yaml.safe_dump(item, sort_keys=False).strip()))
        yield ordinal, None if name is None else str(name), str(item)


class _FileReader(DataSourceReader):
    def __init__(self, source: "_FileSource") -> None:
        self.source = source

    def partitions(self) -> list[InputPartition]:
        system, place = opened(self.source.options["path"])
        found = system.get_file_info([place])[0]
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.source.options["path"])
        if found.type == fs.FileType.File:
            return [Files(paths=[place] if place.lower().endswith(self._suffixes()) else [])]
        deep = self.source.options.get("recursive", "true").lower() == "true"
        parts, size, count, todo = [Files()], 0, 0, [place]
        while todo:
            folder, below, own, files = todo.pop(), [], 0, 0
            for path, is_folder, length in entries(system, folder):
                if is_folder:
                    below.append(path)
                elif path.lower().endswith(self._suffixes()):
                    own, files = own + length, files + 1
            if deep:
                todo += sorted(below, reverse=True)
            if not files:
                continue
            shares = max(-(-own // PART_BYTES), -(-files // PART_FILES), 1)
            for share in range(min(shares, files)):
                if parts[-1].folders and (size + own // shares > PART_BYTES or count + files // shares > PART_FILES):
                    parts.append(Files())
                    size = count = 0
                parts[-1].folders.append((folder, share, min(shares, files)))
                size, count = size + own // shares, count + files // shares
        return parts

    def _suffixes(self) -> tuple[str, ...]:
        return tuple(f".{s.strip()}" for s in self.source.options.get("suffixes", self.source.suffixes).split(","))

    def _paths(self, system: fs.FileSystem, partition: Files) -> Iterator[str]:
        yield from partition.paths
        for folder, share, shares in partition.folders:
            yield from sorted(path for path, is_folder, _ in entries(system, folder, sizes=False) if not is_folder and path.lower().endswith(self._suffixes()) and share_of(path, shares) == share)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.source.options["path"])
        for path in self._paths(system, partition):
            try:
                with system.open_input_file(path) as held:
                    raw = held.read()
                rows = list(self.source.rows(raw))  # a file that fails half-way gives its error only
            except Exception as e:  # noqa: BLE001  one file's failure is one row
                yield (path, *[None] * self.source.width, f"{type(e).__name__}: {e}")
            else:
                for row in rows:
                    yield (path, *row, None)


class _FileSource(DataSource):
    fields, width, suffixes = "", 0, ""

    def schema(self) -> str:
        return f"path string, {self.fields}, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FileReader(self)

    def rows(self, raw: bytes) -> Iterator[tuple]:
        raise NotImplementedError


class ConversionPairs(_FileSource):
    """path, idx, sql, parsed_sql, metadata, error."""

    fields, width, suffixes = "idx int, sql string, parsed_sql string, metadata map<string,string>", 4, "yaml,yml"

    @classmethod
    def name(cls) -> str:
        return "conversion_pairs"

    def rows(self, raw: bytes) -> Iterator[tuple]:
        return pairs_of(raw.decode("utf-8"))


class YamlChecklist(_FileSource):
    """path, ordinal, name, item, error; option ``key``: the dotted place of the list."""

    fields, width, suffixes = "ordinal int, name string, item string", 3, "yaml,yml"

    @classmethod
    def name(cls) -> str:
        return "yaml_checklist"

    def rows(self, raw: bytes) -> Iterator[tuple]:
        return checks_of(raw.decode("utf-8"), self.options.get("key", "llm_checks"))


class SourceTree(_FileSource):
    """path, content, size, error; bytes that are no UTF-8 are replaced, or are errors with option ``strict``."""

    fields, width, suffixes = "content string, size long", 2, "pc,h"

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def rows(self, raw: bytes) -> Iterator[tuple]:
        yield raw.decode("utf-8", "strict" if self.options.get("strict", "false").lower() == "true" else "replace"), len(raw)


@dataclass
class Written(WriterCommitMessage):
    #: the task's folder: files 0, 1, ... and NAMES, lines of (name, number), sorted
    own: str


class _TextFileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.encoding = options["path"], overwrite, options.get("encoding", "utf-8")
        self.aside = f"_aside-{uuid.uuid4().hex}"
        system, place = opened(self.path)
        system.create_dir(posixpath.join(place, self.aside), recursive=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, place = opened(self.path)
        names: list[tuple[str, int]] = []
        own = posixpath.join(place, self.aside, uuid.uuid4().hex)
        system.create_dir(own, recursive=False)  # fails once the folder is gone: a task that goes on after an abort leaves nothing
        for row in iterator:
            name = posixpath.normpath(row.name)
            if name.startswith(("/", "..")) or name == ".":
                raise ValueError(f"no file name: {row.name!r}")
            with system.open_output_stream(posixpath.join(own, str(len(names)))) as out:
                out.write((row.content or "").encode(self.encoding))
            names.append((name, len(names)))
        with system.open_output_stream(posixpath.join(own, NAMES)) as out:
            for some in itertools.batched(sorted(names), LOOK_AT):
                out.write("".join(f"{json.dumps(x)}\n" for x in some).encode())
        return Written(own)

    def _listed(self, own: str) -> Iterator[tuple[str, str]]:
        """name and place of a task's files; its list is opened anew for each piece, as there may be many tasks."""
        system, _ = opened(self.path)
        at, rest = 0, b""
        while True:
            with system.open_input_file(posixpath.join(own, NAMES)) as held:
                held.seek(at)
                piece = held.read(LIST_BYTES)
            if not piece:
                return
            at += len(piece)
            *lines, rest = (rest + piece).split(b"\n")
            for name, number in map(json.loads, lines):
                yield name, posixpath.join(own, str(number))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = opened(self.path)
        files = lambda: heapq.merge(*(self._listed(m.own) for m in messages if m is not None))
        twice = list(itertools.islice((a[0] for a, b in itertools.pairwise(files()) if a[0] == b[0]), 3))
        there = (name for some in itertools.batched((name for name, _ in files()), LOOK_AT) for name, info in zip(some, system.get_file_info([posixpath.join(place, n) for n in some])) if info.type != fs.FileType.NotFound)
        there = [] if self.overwrite or twice else list(itertools.islice(there, 3))
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files written twice: {list(dict.fromkeys(twice))}" if twice else f"files are there already: {there}")
        system.create_dir(place, recursive=True)
        made = ""
        with ThreadPoolExecutor(MOVERS) as movers:
            for some in itertools.batched(files(), LOOK_AT):
                targets = [posixpath.join(place, name) for name, _ in some]
                for target in targets:
                    if made != (folder := posixpath.dirname(target)):
                        system.create_dir(made := folder, recursive=True)
                list(movers.map(system.move, (held for _, held in some), targets))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = opened(self.path)
        aside = posixpath.join(place, self.aside)
        for wait in (0, 0.1, 0.3, 1):  # a task may be at its last file
            time.sleep(wait)
            with contextlib.suppress(OSError):
                if system.get_file_info([aside])[0].type == fs.FileType.NotFound:
                    return
                system.delete_dir(aside)


class TextFiles(DataSource):
    """A file for each row (name, content); mode append fails where a file is there, overwrite replaces it and leaves others."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if {"name", "content"} - set(schema.names):
            raise ValueError("text_files writes rows with name and content")
        return _TextFileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    ship(spark)
    for source in (ConversionPairs, YamlChecklist, SourceTree, TextFiles):
        spark.dataSource.register(source)
