"""Reading source trees, conversion pairs and sessions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOURCE_SUFFIXES = ("pc", "h")
GRAPH_SUFFIXES = ("c", "pc", "h", "cpp", "hpp")


def source_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SOURCE_SUFFIXES, recursive: bool = True) -> DataFrame:
    """file_id (path) and content of each source file under ``path``, undecodable bytes replaced."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    return reader.load(path).select(F.col("path").alias("file_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modification time of all files, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def globbed(paths: DataFrame, pattern: str) -> DataFrame:
    """Paths that a pattern names: ``*`` and ``?`` stay within a folder, ``**`` goes through any number of them."""
    steps = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(steps.get(x) or (x if x.startswith("[") else re.escape(x)) for x in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|[^*?\[]+|\[", pattern))
    return paths.where(F.regexp_like("path", F.lit(f"^(?:.*/)?{body}$" if not pattern.startswith("/") else f"^{body}$")))


def tree(paths: DataFrame, depth: int | None = None, hidden: bool = False, folders_only: bool = False) -> DataFrame:
    """folder or file of each place (relative paths, length) as lines of a tree: ``at`` (sorts them), ``path``, ``line``.

    Folders come first, then by name, case aside. Levels are windows over siblings, whether a
    folder is its parent's last decides what stands before all that lies in it.
    """
    parts = F.split("path", "/")
    upto = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    places = paths.select("length", F.size(parts).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("level"), upto(k).alias("place"), (k < F.size(parts)).alias("is_folder")))).alias("p"))
    nodes = places.select("p.*", F.when(~F.col("p.is_folder"), F.col("length")).alias("length")).groupBy("place", "level", "is_folder").agg(F.max("length").alias("length"))
    nodes = nodes.withColumns({"name": F.element_at(F.split("place", "/"), -1), "parent": F.regexp_extract("place", r"^(.*)/[^/]*$", 1)})
    if not hidden:
        nodes = nodes.where(~F.regexp_like("place", F.lit(r"(?:^|/)\.")))
    if folders_only:
        nodes = nodes.where("is_folder")
    if depth is not None:
        nodes = nodes.where(F.col("level") <= depth)
    siblings = Window.partitionBy("parent").orderBy(F.desc("is_folder"), F.lower("name"), "name")
    ranked = nodes.withColumns({"rank": F.row_number().over(siblings), "is_last": F.lead("name").over(siblings).isNull()})
    above = ranked.where("is_folder").select(F.col("place").alias("folder"), F.col("level").alias("folder_level"), F.col("rank").alias("folder_rank"), F.col("is_last").alias("folder_last"))
    chain = ranked.select("place", F.explode(F.transform(F.sequence(F.lit(1), F.col("level")), lambda k: F.array_join(F.slice(F.split("place", "/"), F.lit(1), k), "/"))).alias("folder")).where("folder <> place").join(above, "folder")
    before = chain.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("folder_level", "folder_rank", "folder_last"))).alias("above"))
    led = F.array_join(F.transform(F.coalesce("above", F.expr("cast(array() as array<struct<folder_level: int, folder_rank: int, folder_last: boolean>>)")), lambda a: F.when(a["folder_last"], "    ").otherwise("│   ")), "")
    shown = F.when(F.col("is_folder"), F.concat("name", F.lit("/"))).otherwise(F.format_string("%s (%d bytes)", "name", "length"))
    order = F.concat(F.transform(F.coalesce("above", F.expr("cast(array() as array<struct<folder_level: int, folder_rank: int, folder_last: boolean>>)")), lambda a: a["folder_rank"]), F.array("rank"))
    return ranked.join(before, "place", "left").select(order.alias("at"), F.col("place").alias("path"), F.concat(led, F.when(F.col("is_last"), "└── ").otherwise("├── "), shown).alias("line"))


def conversion_pairs(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, sql, parsed_sql, metadata of each YAML file's pairs; items that are none are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                items = yaml.safe_load(bytes(content).decode("utf-8", "replace")) or []
                for idx, item in enumerate(items if isinstance(items, list) else [items]):
                    if isinstance(item, dict) and item.get("sql") is not None and item.get("parsed_sql") is not None:
                        rest = {str(k): str(v) for k, v in item.items() if k not in ("sql", "parsed_sql")}
                        rows.append((name, idx, str(item["sql"]).strip(), str(item["parsed_sql"]).strip(), rest))
            yield pd.DataFrame(rows, columns=["file", "idx", "sql", "parsed_sql", "metadata"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,yml}").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, idx int, sql string, parsed_sql string, metadata map<string,string>")


def session_items(spark: SparkSession, path: str) -> DataFrame:
    """idx, status, comment of a saved session."""
    return spark.read.schema("statuses map<string,string>, comments map<string,string>").option("multiLine", True).json(path).select(F.explode("statuses").alias("idx", "status"), "comments").select(F.col("idx").cast("int"), "status", F.try_element_at("comments", "idx").alias("comment"))


def prompts(files: DataFrame) -> DataFrame:
    """Texts (path, content) that hold both places of a conversion, {asis} and {tobe}."""
    return files.where(F.contains("content", F.lit("{asis}")) & F.contains("content", F.lit("{tobe}")))


def filled(prompt: Column, asis: Column, tobe: Column) -> Column:
    return F.replace(F.replace(prompt, F.lit("{asis}"), asis), F.lit("{tobe}"), tobe)


def with_front_matter(files: DataFrame) -> DataFrame:
    """Texts (path, content) with their front matter: ``meta`` (keys and values of its lines) and ``body``."""
    head = F.regexp_extract("content", r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    pairs = F.regexp_extract_all(head, F.lit(r"(?m)^(\w[\w-]*):[ \t]*(.*?)[ \t]*$"), F.lit(0))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w[\w-]*):", 1), F.regexp_replace(F.regexp_extract(x, r":[ \t]*(.*?)[ \t]*$", 1), "^[\"']|[\"']$", ""))))
    return files.withColumns({"meta": meta, "body": F.regexp_replace("content", r"(?s)^---\s*\n.*?\n---\s*\n", "")})


def checklists(files: DataFrame, key: str = "llm_checks") -> DataFrame:
    """path, ordinal, item: the items of a list under a key of simple YAML texts."""
    listed = F.regexp_extract("content", rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1)
    items = F.regexp_extract_all(listed, F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t]*$"), F.lit(1))
    return files.select("path", F.posexplode(items).alias("ordinal", "item")).withColumn("item", F.regexp_replace("item", "^[\"']|[\"']$", ""))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Episodes and workflows kept as JSON, a file for each or a line for each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
