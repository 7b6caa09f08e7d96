"""Counts over overlapping chunks of files that equal counts over the whole files.

A chunk is counted up to where the next begins, moved on to a place where no word or
comment sign is cut, which both chunks find in their overlap. What its text counts
depends on how it begins (in code, in a comment, after ``EXEC`` or ``EXEC SQL``), so a
chunk's summary holds, for each way to begin, the way it ends and its counts. Such
summaries merge in order: the end of one picks the entry of the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.rules import FIRST_WORDS
from ..session import ship

#: ways to be: in code, a block comment or a line comment, each with nothing, EXEC, or EXEC SQL before
CODE, BLOCK, LINE = 0, 3, 6
STATES = 9
_TOKEN = re.compile(r"/\*|\*/|//|--|\n|\w+|[^\s\w]")
_SIGNS = {"/*", "*/", "//", "--"}


def _border(text: str) -> int:
    """The first place that cuts no word and no sign of a comment; the text's length without one."""
    for k in range(len(text)):
        if k and not (re.match(r"\w\w", text[k - 1 : k + 1]) or text[k - 1 : k + 1] in _SIGNS):
            return k
    return len(text)


def _run(tokens: list[str], state: int, words: dict[str, int]) -> tuple[int, list[int]]:
    counts = [0] * len(words)
    for t in tokens:
        mode, seen = state - state % 3, state % 3
        if mode == BLOCK:
            state = CODE + seen if t == "*/" else state
        elif mode == LINE:
            state = CODE + seen if t == "\n" else state
        elif t == "/*":
            state = BLOCK + seen
        elif t in ("//", "--"):
            state = LINE + seen
        elif t != "\n":
            word = t.upper()
            if seen == 2 and word in words:
                counts[words[word]] += 1
            state = 2 if seen == 1 and word == "SQL" else 1 if word == "EXEC" else 0
    return state, counts


def chunk_counts(chunks: DataFrame, key: str = "file_id", words: tuple[str, ...] = FIRST_WORDS) -> DataFrame:
    """key, keyword, n: words right after EXEC SQL, comments aside, over chunks (key, chunk, start, end, raw) of files."""
    order = Window.partitionBy(key).orderBy("chunk")
    after = F.lead("start").over(order)
    # what follows the next chunk's start is there twice; where it starts is known to both
    framed = chunks.select(key, "chunk", (F.col("chunk") > F.min("chunk").over(Window.partitionBy(key))).alias("follows"), F.substring("raw", 1, F.coalesce(F.col("end") - F.col("start"), F.lit(0)).cast("int")).alias("raw"), (after - F.col("start")).alias("next_at"), (F.lag("end").over(order) - F.col("start")).alias("shared"))
    index = {w: k for k, w in enumerate(words)}
    schema = T._parse_datatype_string(f"{key} {chunks.schema[key].dataType.simpleString()}, chunk int, ends array<int>, counts array<array<long>>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, ends, counts = [], [], [], []
            for k, chunk, follows, raw, next_at, shared in zip(*(c.to_pylist() for c in batch.columns)):
                first = _border(raw[: max(0, shared or 0)]) if follows else 0
                last = len(raw) if next_at is None else next_at + _border(raw[next_at:])
                tokens = _TOKEN.findall(raw[first:last])
                made = [_run(tokens, s, index) for s in range(STATES)]
                keys.append(k)
                numbers.append(chunk)
                ends.append([m[0] for m in made])
                counts.append([m[1] for m in made])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, numbers, ends, counts), arrow)], schema=arrow)

    ship(chunks.sparkSession)
    summaries = framed.mapInArrow(run, schema)
    start = F.struct(F.lit(CODE).alias("state"), F.array_repeat(F.lit(0).cast("long"), len(words)).alias("counts"))
    step = lambda acc, c: F.struct(F.get(c["ends"], acc["state"]).alias("state"), F.zip_with(acc["counts"], F.get(c["counts"], acc["state"]), lambda a, b: a + b).alias("counts"))
    merged = summaries.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "ends", "counts"))), start, step).getField("counts").alias("counts"))
    named = F.arrays_zip(F.array(*map(F.lit, words)).alias("keyword"), F.col("counts").alias("n"))
    return merged.select(key, F.inline(named)).where("n > 0")


def totals(counts: DataFrame) -> DataFrame:
    """keyword, n, files over all files."""
    return counts.groupBy("keyword").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))
