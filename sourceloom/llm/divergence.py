"""How far the sources of a language differ in their words: counts by DuckDB over hash shards, sums and ranks by Spark.

Each task counts its documents' terms by language and source. Counts are sharded
by a hash of language and term, so all sources of a term meet in one shard, where
DuckDB adds them up block by block (a shard is sorted, a block ends between two
terms, so its memory is bounded) and drops terms of too few documents. With the
totals of all groups, which Spark adds up, a second pass over the shards lets
DuckDB sum each pair of sources over the terms of a block, and find each source's
leading terms; Spark merges these partial sums and ranks.

A pair's distance runs over all kept terms, whether a source has them or not. Only
terms that both sources have meet in a shard; what a source's own terms are away
from the other's share of an absent term follows from the source's histogram of
counts, and terms that neither has all add the same:

    sum |p-q| = sum over common terms (|p-q| - |p-q0| - |p0-q| + |p0-q0|)
              + sum over terms of p |p-q0| + sum over terms of q |p0-q|
              + (all - terms of p - terms of q) |p0-q0|

Defined results: null text, language and source are empty strings, which are a
language and a source like any other; a group without terms has the share of
absent terms everywhere; a language without kept terms has pairs of value 0; a
lone source has no pairs; repeated rows count again; texts of any length are
counted whole; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import ship
from .common import give_back, map_rows, partitions, stored

#: documents of its language that a kept term is in, and ranks of terms
LEAST_DOCS, TOP_TERMS = 30, 50
#: what is added to each count, and what a share of one is in whole numbers
SMOOTH, UNIT = 5, 1_000_000_000
#: different terms that a task holds before it passes its counts on, and rows of a shard that DuckDB gets at a time
HELD_TERMS, BLOCK_ROWS = 400_000, 200_000
#: what DuckDB may use in a task; blocks stay far below it
DUCKDB = {"threads": 1, "memory_limit": "600MB", "temp_directory": ""}

#: bytes outside of terms as spaces, A-Z in lower case
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), several rows for one key; the term '' counts the documents themselves."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[dict]:
        for (lang, source), (n, d) in held.items():
            terms = list(d)
            yield {"lang": [lang] * len(terms), "source": [source] * len(terms), "term": terms, "n": [n[t] for t in terms], "d": list(d.values())}

    def count(chunks: Iterator[list[list]]) -> Iterator[dict]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for langs, sources, texts in chunks:
            for lang, source, text in zip(langs, sources, texts):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(_TERMS).split()
                n.update(terms)
                d.update({*terms, b""})
            if sum(len(d) for _, d in held.values()) > HELD_TERMS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    source = docs.select(plain("lang"), plain("source"), plain("text").cast("binary").alias("text"))
    return map_rows(source, ["lang", "source", "text"], count, "lang string, source string, term string, n long, d long")


def by_shard(df: DataFrame, statements: dict[str, str], schema: str, merge: str = "SELECT * FROM rows", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run DuckDB SQL over hash shards by lang and term, in blocks of whole terms.

    ``merge`` (over ``rows``) makes a block smaller and may run again over its
    own rows; ``statements`` run over ``block``, the merged rows of whole terms, and
    give the columns of ``schema``, where ``kind`` is the statement's name.
    """
    ship(df.sparkSession)
    out = T._parse_datatype_string("kind string, " + schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        base = duckdb.connect(config=DUCKDB)

        def merged(parts: list[pa.RecordBatch]) -> pa.Table:
            base.register("rows", pa.Table.from_batches(parts))
            found = base.sql(merge).to_arrow_table()
            base.unregister("rows")
            return found

        def answers(block: pa.Table) -> Iterator[pa.RecordBatch]:
            base.register("block", block)
            for kind, sql in statements.items():
                found = base.sql(f"SELECT '{kind}' AS kind, * FROM ({sql})").to_arrow_table()
                yield from found.select(arrow.names).cast(arrow).to_batches(max_chunksize=20_000)
            base.unregister("block")

        parts, size, limit = [], 0, block_rows
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch)
            size += batch.num_rows
            if size >= limit:  # all but the last term are whole
                last = {k: batch.column(k)[-1] for k in ("lang", "term")}
                block = merged(parts)
                is_last = pa.compute.and_(*(pa.compute.equal(block[k], v.cast(block.schema.field(k).type)) for k, v in last.items()))
                yield from answers(block.filter(pa.compute.invert(is_last)))
                rest = block.filter(is_last).cast(batch.schema)
                parts, size = rest.to_batches(), rest.num_rows
                limit = max(block_rows, 2 * size)
        if parts:
            yield from answers(merged(parts))
        base.close()
        give_back()

    sharded = df.repartition(partitions(df.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return sharded.mapInArrow(run, out)


_MERGE = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS d FROM rows GROUP BY lang, source, term"


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of kept terms, and all (lang, source); stored."""
    statements = {
        "term": f"SELECT lang, source, term, n FROM (SELECT *, sum(d) OVER (PARTITION BY lang, term) AS docs FROM block WHERE term <> '') WHERE docs >= {least_docs}",
        "group": "SELECT lang, source, term, n FROM block WHERE term = ''",
    }
    found = stored(by_shard(term_counts(docs), statements, "lang string, source string, term string, n long", _MERGE, block_rows), "kind")
    return found.where("kind = 'term'").drop("kind"), found.where("kind = 'group'").select("lang", "source")


def totals(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, own (terms the source has), below (N + SMOOTH * V), lang_below, kept (V): a row for each group; stored."""
    kept = terms.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    counts = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    by_lang = counts.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(kept, "lang")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return stored(
        groups.join(counts, ["lang", "source"], "left")
        .join(by_lang, "lang", "left")
        .select("lang", "source", zero("own").alias("own"), zero("kept").alias("kept"), (zero("total") + SMOOTH * zero("kept")).alias("below"), (zero("lang_total") + SMOOTH * zero("kept")).alias("lang_below"))
    )


def shares_apart(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item, far: how far the source's terms, and its part of those that neither has, are from the other's share of an absent term."""
    histogram = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("h")).groupBy("lang", "source").agg(F.collect_list("n").alias("counts"), F.collect_list("h").alias("numbers"))
    others = stats.groupBy("lang").agg(F.collect_list("source").alias("items"), F.collect_list("below").alias("belows"), F.collect_list("own").alias("owns"))
    none = F.expr("cast(array() as array<bigint>)")
    rows = stats.join(histogram, ["lang", "source"], "left").join(others, "lang").select("lang", "source", "own", "kept", "below", F.coalesce("counts", none).alias("counts"), F.coalesce("numbers", none).alias("numbers"), "items", "belows", "owns")

    def share(counts: list[int], below: int) -> np.ndarray:
        """In Python's numbers, as a count times UNIT may need over 64 bits."""
        return np.array([1 + UNIT * (c + SMOOTH) // below for c in counts], np.int64)

    def run(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for columns in chunks:
            for lang, source, own, kept, below, counts, numbers, items, belows, owns in zip(*columns):
                far, rest = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
                if kept:
                    absent = np.array([1 + UNIT * SMOOTH // b for b in belows], np.int64)
                    p = share(counts, below)
                    order = np.argsort(p, kind="stable")
                    p, h = p[order], np.array(numbers, np.int64)[order]
                    many, mass = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * p)])
                    at = np.searchsorted(p, absent)
                    far = absent * (2 * many[at] - many[-1]) + mass[-1] - 2 * mass[at]
                    rest = (kept - own - np.array(owns, np.int64)) * np.abs(absent - (1 + UNIT * SMOOTH // below))
                other = [k for k, item in enumerate(items) if item != source]
                yield {"lang": [lang] * len(other), "source": [source] * len(other), "item": [items[k] for k in other], "far": far[other], "rest": rest[other]}

    return map_rows(rows, rows.columns, run, "lang string, source string, item string, far long, rest long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    terms, groups = kept_terms(docs, least_docs, block_rows)
    stats = totals(terms, groups)
    share = lambda n, below: f"CAST(1 + (CAST({UNIT} AS HUGEINT) * ({n} + {SMOOTH})) // {below} AS BIGINT)"
    shares = f"SELECT lang, source, term, {share('n', 'below')} AS p, {share('0', 'below')} AS p0, {share('sum(n) OVER (PARTITION BY lang, term)', 'lang_below')} AS q FROM block"
    statements = {
        "pair": f"""
WITH s AS ({shares})
SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0)) AS BIGINT) AS value
FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""",
        "term": f"SELECT lang, source, term AS item, p - q AS value FROM ({shares}) WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top_terms}",
    }
    found = stored(by_shard(terms.join(stats, ["lang", "source"]).select("lang", "source", "term", "n", "below", "lang_below"), statements, "lang string, source string, item string, value long", block_rows=block_rows), "kind")
    apart = shares_apart(terms, stats)
    turned = [F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item")]
    common = found.where("kind = 'pair'")
    sums = (
        common.select("lang", "source", "item", "value")
        .unionByName(common.select(*turned, "value"))
        .unionByName(apart.select("lang", "source", "item", F.explode(F.array("far", "rest")).alias("value")))
        .unionByName(apart.select(*turned, F.col("far").alias("value")))
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(sums, "pair").unionByName(ranked(found.where("kind = 'term'"), "term").where(F.col("rank") <= top_terms))
