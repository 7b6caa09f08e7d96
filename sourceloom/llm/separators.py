"""Token counts of documents in flat token files that have no index.

A flat file is a run of fixed-width token ids in which an end-of-document id
closes each document. Tasks read byte ranges of it and search them on their own;
a prefix scan over one small row for each range then says how many documents
ended before it and how many tokens stand open, which stitches documents across
ranges. Files may have any size; an id too large for the width is an error.

Defined results: an empty text counts 0 tokens; tokens after the last separator
form a document with ``closed`` false; null texts are empty, repeated rows count
again, an empty table or file gives no rows. Strings of special tokens in a
text are ordinary text, so a text can't close its document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, partitions, shared_dir, stored, with_bytes
from .tokens import tokenizer

BLOCK_TOKENS = 1 << 18
#: ids of documents in one row of a manifest
MANIFEST_ROWS = 4096


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name as Spark gives it (file:/x has one slash there)."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def flatten(docs: DataFrame, path: str, separator: int, dtype: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Write documents as flat binary files in the shared folder, one for each task: the files, and the doc_ids in order.

    files: file_id, path, length (bytes). manifest: file_id, first, doc_ids. A
    repeated task writes a file of its own; only that of the one whose rows
    count is named. The files go when the application ends.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    most = np.iinfo(dtype).max

    def write(chunks: Iterator[list[list]]) -> Iterator[dict]:
        file_id, encode = TaskContext.get().partitionId(), tokenizer(path, plain_specials=True).encode
        end = np.array([separator], dtype).tobytes()
        system, place = _opened(folder)
        system.create_dir(place, recursive=True)
        name, first, length = f"{uuid.uuid4().hex}.bin", 0, 0
        with system.open_output_stream(f"{place}/{name}") as out:
            for doc_ids, raws in chunks:
                for packed in encode(raws):
                    ids = np.frombuffer(packed, "<u4")
                    if len(ids) and ids.max() > most:
                        raise ValueError(f"token id {ids.max()} does not fit into {dtype}")
                    length += out.write(ids.astype(dtype).tobytes() + end)
                starts = range(0, len(doc_ids), MANIFEST_ROWS)
                n = len(starts)
                yield {"kind": ["manifest"] * n, "file_id": [file_id] * n, "path": [None] * n, "length": [first + at for at in starts], "doc_ids": [doc_ids[at : at + MANIFEST_ROWS] for at in starts]}
                first += len(doc_ids)
        if length:
            yield {"kind": ["file"], "file_id": [file_id], "path": [f"{folder}/{name}"], "length": [length], "doc_ids": [None]}

    flat = stored(map_rows(with_bytes(docs), ["doc_id", "raw"], write, "kind string, file_id int, path string, length long, doc_ids array<long>", "tokens"), "kind")
    kept = spark._jvm.org.apache.hadoop.fs.Path(folder)
    kept.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(kept)
    manifest = flat.where("kind = 'manifest'").select("file_id", F.col("length").alias("first"), "doc_ids")
    return flat.where("kind = 'file'").select("file_id", "path", "length"), manifest


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """Flat files of any size that lie under ``path``: file_id (the file's path), path, length."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "path", "length")


def blocks_of(files: DataFrame, dtype: str = "<u2") -> DataFrame:
    """Byte ranges of files: file_id, block_no, path, start, size; dealt over all tasks, whatever a file's size."""
    width = np.dtype(dtype).itemsize * BLOCK_TOKENS
    numbered = files.select("file_id", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width))).alias("block_no"))
    ranges = numbered.select("file_id", "block_no", "path", (F.col("block_no") * width).alias("start"), F.least(F.lit(width), F.col("length") - F.col("block_no") * width).alias("size"))
    return ranges.repartition(partitions(files.sparkSession), "file_id", "block_no")


def count_tokens(files: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """file_id, ordinal, n_tokens, closed: a row for each document of each file (file_id, path, length)."""
    key = files.schema["file_id"].dataType.simpleString()

    def search(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for names, numbers, paths, starts, sizes in chunks:
            out: dict[str, list] = {"file_id": names, "block_no": numbers, "n_tokens": [], "n_ended": [], "after": [], "gaps": []}
            for path, start, size in zip(paths, starts, sizes):
                system, place = _opened(path)
                with system.open_input_file(place) as held:
                    ids = np.frombuffer(held.read_at(size, start), dtype)
                ends = np.flatnonzero(ids == separator)
                out["n_tokens"].append(len(ids))
                out["n_ended"].append(len(ends))
                out["after"].append(int(ends[-1]) + 1 if len(ends) else None)
                out["gaps"].append((np.diff(ends, prepend=-1) - 1).tolist())
            yield out

    found = stored(map_rows(blocks_of(files, dtype), ["file_id", "block_no", "path", "start", "size"], search, f"file_id {key}, block_no long, n_tokens long, n_ended long, after long, gaps array<long>"))
    order = Window.partitionBy("file_id").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the scan holds a few numbers for each range; the counts stay where they are stored and meet their range's start again
    scanned = (
        found.drop("gaps")
        .withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("n_ended").over(before), F.lit(0)))
        .withColumn("ended", F.coalesce(F.max(F.col("start") + F.col("after")).over(before), F.lit(0)))
        .withColumn("last", F.lead("block_no").over(order).isNull())
    )
    opened, tail = F.col("start") - F.col("ended"), F.col("n_tokens") - F.coalesce("after", F.lit(0))
    scanned = scanned.join(found.select("file_id", "block_no", "gaps").hint("merge"), ["file_id", "block_no"])
    gaps = F.when(F.col("last") & (F.when(F.col("n_ended") > 0, tail).otherwise(tail + opened) > 0), F.concat("gaps", F.array(tail))).otherwise(F.col("gaps"))
    return scanned.select("file_id", "ordinal", "n_ended", opened.alias("opened"), F.posexplode(gaps).alias("k", "gap")).select(
        "file_id",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        (F.col("gap") + F.when(F.col("k") == 0, F.col("opened")).otherwise(0)).alias("n_tokens"),
        (F.col("k") < F.col("n_ended")).alias("closed"),
    )


def document_tokens(docs: DataFrame, path: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """doc_id, file_id, ordinal, n_tokens: counts read back from the flat files of ``docs``."""
    files, manifest = flatten(docs, path, separator, dtype)
    names = manifest.select("file_id", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file_id", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    # both sides grow with the documents: neither may be broadcast, however small its file looks
    return names.join(count_tokens(files, separator, dtype).hint("merge"), ["file_id", "ordinal"]).select("doc_id", "file_id", "ordinal", "n_tokens")
