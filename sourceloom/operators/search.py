"""Search of notes by words: an inverted index on disk, many queries at once, top results without reading whole lists.

A note's score is the share of the query's distinct words that it holds. A query
first looks at the beginnings of its words' lists, which gives it some results and so
a bound: a note can only do better if it holds one of the query's rarest words,
so many that the others alone could not reach the bound. Only those lists are
read on, the last of them up to the id that would win a tie. Results equal those of a
scan of all notes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship
from ..storage import shared_dir, stored

#: rows of the index that one task puts in order
RANGE = 1 << 20


def words_of(text: Column) -> Column:
    """The distinct words of a text, in lower case, cut at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != ""))


def write_index(notes: DataFrame, path: str | None = None, most: int = RANGE) -> str:
    """Index notes (entry_id, content; ids are unique): their words, and each word's notes by id with their place; where it lies.

    The lists lie one after the other in ranges of about ``most`` rows, so that a
    task sorts no more however long they are. A row's seat is its place among its
    word's rows of its range; only a word that begins in an earlier range has
    other rows before.
    """
    spark = notes.sparkSession
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    notes.select("entry_id", words_of(F.col("content")).alias("words")).write.parquet(f"{path}/notes")
    kept = spark.read.parquet(f"{path}/notes")
    held = kept.select(F.explode("words").alias("word"), "entry_id")
    ranges = max(spark.sparkContext.defaultParallelism, -(-(kept.agg(F.sum(F.size("words"))).first()[0] or 0) // most))
    ordered = held.repartitionByRange(ranges, "word", "entry_id").sortWithinPartitions("word", "entry_id")
    schema = T.StructType([*ordered.schema, T.StructField("range", T.IntegerType()), T.StructField("seat", T.LongType())])
    ship(spark)
    ordered.mapInArrow(_seated, schema).write.parquet(f"{path}/postings")
    sizes = spark.read.parquet(f"{path}/postings").groupBy("word", "range").agg(F.max("seat").alias("n"))
    sizes = stored(sizes)
    before = Window.partitionBy("word").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("word", "range", F.sum("n").over(before).alias("start"))
    starts.where(F.col("start").isNotNull()).write.parquet(f"{path}/starts")  # one row a range at most
    sizes.groupBy("word").agg(F.sum("n").alias("df")).write.parquet(f"{path}/words")
    return path


def _seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, in order, with its number and their seats."""
    number, last, taken = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        rows, word = batch.num_rows, batch.column(0)
        if not rows:
            continue
        at = np.arange(rows)
        turn = np.append(True, pc.not_equal(word.slice(1), word.slice(0, rows - 1)).to_numpy(zero_copy_only=False))
        first = np.maximum.accumulate(np.where(turn, at, 0))
        seat = at - first + 1
        if word[0].as_py() == last:
            seat[first == 0] += taken
        last, taken = word[rows - 1].as_py(), int(seat[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(rows, number, np.int32)), pa.array(seat)], ["word", "entry_id", "range", "seat"])


def _counted(pairs: DataFrame, asked: DataFrame, notes: DataFrame) -> DataFrame:
    """query_id, entry_id, hits of some pairs."""
    return pairs.join(notes, "entry_id").join(asked.select("query_id", F.col("words").alias("_asked")), "query_id").select("query_id", "entry_id", F.size(F.array_intersect("words", "_asked")).alias("hits"))


def search(spark: SparkSession, path: str, queries: DataFrame, most: int = 5) -> DataFrame:
    """query_id, entry_id, hits, score, rank: for each query (query_id, text) the ``most`` best notes that share a word with it, ties by id."""
    notes, seated, starts, known = (spark.read.parquet(f"{path}/{name}") for name in ("notes", "postings", "starts", "words"))
    place = F.col("seat") + F.coalesce("start", F.lit(0))
    placed = lambda rows: rows.join(F.broadcast(starts), ["word", "range"], "left").withColumn("place", place)
    asked = stored(queries.select("query_id", words_of(F.col("text")).alias("words")))
    rarest = Window.partitionBy("query_id").orderBy("df", "word")
    terms = asked.select("query_id", F.explode("words").alias("word")).join(known, "word")
    terms = stored(terms.withColumn("rank", F.row_number().over(rarest)).withColumn("n", F.count("*").over(Window.partitionBy("query_id"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("hits"), "entry_id")

    begun = terms.join(placed(seated.where(F.col("seat") <= most)).where(F.col("place") <= most), "word").select("query_id", "entry_id").distinct()
    found = stored(_counted(begun, asked, notes))
    last = found.withColumn("at", F.row_number().over(best)).where(F.col("at") == most).select("query_id", F.col("hits").alias("bound"), F.col("entry_id").alias("tie"))
    # without ``most`` results there is no bound, and all lists are read
    going = terms.join(last, "query_id", "left").where(F.col("bound").isNull() | (F.col("rank") <= F.col("n") - F.col("bound") + 1))
    better = F.col("bound").isNull() | (F.col("rank") <= F.col("n") - F.col("bound")) | (F.col("entry_id") < F.col("tie"))
    more = going.join(placed(seated).where(F.col("place") > most), "word").where(better).select("query_id", "entry_id").distinct()
    every = found.unionByName(_counted(more.join(found, ["query_id", "entry_id"], "left_anti"), asked, notes))
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    sizes = asked.select("query_id", F.size("words").alias("size"))
    return ranked.join(sizes, "query_id").select("query_id", "entry_id", "hits", (F.col("hits") / F.col("size")).alias("score"), "rank")
