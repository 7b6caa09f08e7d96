"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a polynomial in a fixed base,
modulo four primes, with its length. Fingerprints compose: that of ``a + b`` is
that of ``a`` times the base to the power of the length of ``b``, plus that of
``b``. So each chunk of a huge document is hashed in a task of its own, shifted by
the bytes that follow it, and Spark adds the chunks up in any order. Rows of equal
fingerprints are then compared with the first of them chunk by chunk: a window
over each chunk number holds one chunk of the first text while the same chunk of
the others streams by. What differs is compared again with the first of what
differs, until nothing does, so equal means identical.

Texts are equal when identical after each run of ASCII white space has become one
space. Of a group the smallest doc_id stays; a null doc_id comes after all others.

Defined results: a null text is empty; empty texts are equal to each other, and a
text of white space is one space, so not empty; of rows that agree in doc_id and
text one stays; texts of any length are compared whole; other columns are not
looked at (``without_copies`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, HOT_KEYS, brought_back, map_rows, partitions, set_aside, stored, stored_counting, with_bytes

#: primes and, for each, the base
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1234567891, 987654323, 1618033987, 1414213561)
#: longer texts are hashed and compared in chunks of this many bytes
CHUNK_BYTES = 1 << 16
#: bytes that one row of a matrix product takes: sums stay exact in 53 bits
BLOCK = 256
#: rows that are compared with one copy of the first text's chunks
SALT_ROWS = 256

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalised(raw: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    raw = raw.translate(_SPACES)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def normalised_column(text: Column) -> Column:
    """The same as an expression."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t-\r]+", " ").cast("binary")


class Hasher:
    """Fingerprints of byte strings of at most ``longest`` bytes, many at a time."""

    def __init__(self, moduli: tuple[int, ...] = MODULI, longest: int = CHUNK_BYTES) -> None:
        self.moduli = np.array(moduli, np.uint64)
        self.within = np.array([[pow(b, BLOCK - 1 - k, m) for b, m in zip(BASES, moduli)] for k in range(BLOCK)], np.float64)
        self.after = np.array([[pow(b, BLOCK * k, m) for b, m in zip(BASES, moduli)] for k in range(max(1, -(-longest // BLOCK)))], np.uint64)

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        """One row of four values for each part."""
        blocks = np.array([max(1, -(-len(p) // BLOCK)) for p in parts])
        ends = np.cumsum(blocks)
        held = np.zeros(ends[-1] * BLOCK, np.uint8)
        for part, end in zip(parts, (ends * BLOCK).tolist()):  # zeros before a part change nothing
            held[end - len(part) : end] = np.frombuffer(part, np.uint8)
        values = (held.reshape(-1, BLOCK).astype(np.float64) @ self.within).astype(np.uint64) % self.moduli
        following = np.repeat(ends, blocks) - 1 - np.arange(ends[-1])
        return np.add.reduceat(values * self.after[following] % self.moduli, ends - blocks, axis=0) % self.moduli


def _shifted(values: list[int], after: int, moduli: tuple[int, ...]) -> list[int]:
    """A chunk's share in the fingerprint of a text in which ``after`` bytes follow it."""
    return [v * pow(b, after, m) % m for v, b, m in zip(values, BASES, moduli)]


def fingerprints(docs: DataFrame, moduli: tuple[int, ...] = MODULI, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """rid (a number of the row), doc_id, digest (SHA-256) and print (length and four values) of each normalised text; stored."""

    def hashed(chunks: Iterator[list[list]]) -> Iterator[dict]:
        hasher, rid = Hasher(moduli, chunk_bytes), TaskContext.get().partitionId() << 36
        for doc_ids, raws in chunks:
            texts = [normalised(r) for r in raws]
            rids, rid = list(range(rid, rid + len(texts))), rid + len(texts)
            small = [len(t) <= chunk_bytes for t in texts]
            found = iter(hasher([t for t, s in zip(texts, small) if s]).tolist() if any(small) else ())
            none = [None] * len(texts)
            yield {"chunked": [False] * len(texts), "rid": rids, "doc_id": doc_ids, "n_bytes": [len(t) for t in texts], "digest": [sha256(t).digest() for t in texts], "value": [next(found) if s else None for s in small], "after": none, "part": none}
            for number, text in [(n, t) for n, t, s in zip(rids, texts, small) if not s]:
                for at in range(0, len(text), BATCH_BYTES - BATCH_BYTES % chunk_bytes or chunk_bytes):
                    stop = min(len(text), at + (BATCH_BYTES - BATCH_BYTES % chunk_bytes or chunk_bytes))
                    cut = [(k, text[k : min(k + chunk_bytes, stop)]) for k in range(at, stop, chunk_bytes)]
                    none = [None] * len(cut)
                    yield {"chunked": [True] * len(cut), "rid": [number] * len(cut), "doc_id": none, "n_bytes": none, "digest": none, "value": none, "after": [len(text) - k - len(c) for k, c in cut], "part": [c for _, c in cut]}

    def shares(chunks: Iterator[list[list]]) -> Iterator[dict]:
        hasher = Hasher(moduli, chunk_bytes)
        for rids, after, parts in chunks:
            yield {"rid": rids, "share": [_shifted(v, a, moduli) for v, a in zip(hasher(parts).tolist(), after)]}

    found = stored(map_rows(with_bytes(docs), ["doc_id", "raw"], hashed, "chunked boolean, rid long, doc_id long, n_bytes long, digest binary, value array<long>, after long, part binary"), "chunked")
    dealt = found.where("chunked").select("rid", "after", "part").repartition(partitions(docs.sparkSession), "rid", "after")
    total = [(F.sum(F.col("share")[k]) % m).alias(f"v{k}") for k, m in enumerate(moduli)]
    added = map_rows(dealt, ["rid", "after", "part"], shares, "rid long, share array<long>").groupBy("rid").agg(*total).select("rid", F.array(*(f"v{k}" for k in range(len(moduli)))).alias("value"))
    rows = found.where(~F.col("chunked")).select("rid", "doc_id", "n_bytes", "digest", "value")
    whole = rows.where("value is not null").unionByName(rows.where("value is null").drop("value").join(added, "rid"))
    pair = lambda k: F.shiftleft(F.col("value")[k], 31) + F.col("value")[k + 1]
    return stored(whole.select("rid", "doc_id", "digest", F.struct("n_bytes", pair(0).alias("a"), pair(2).alias("b")).alias("print")))


#: order of the rows of a group: the smallest doc_id first, nulls last
def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")).alias("first")


def _joined(rows: DataFrame, groups: DataFrame, key: str, how: str) -> DataFrame:
    """Rows with their group (stored, with its size ``n``); the at most HOT_KEYS largest groups are broadcast, so none fills a task."""
    bound = (groups.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
    hot = F.broadcast(groups.where(F.col("n") > bound))
    rest = rows.join(F.broadcast(groups.where(F.col("n") > bound).select(key)), key, "left_anti").join(groups.where(F.col("n") <= bound), key, how)
    return rows.join(hot, key).unionByName(rest)


def _different(docs: DataFrame, rows: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Those rows (id, digest, print, n, leads) whose text differs from their leader's somewhere; and how many at least."""
    text = normalised_column(F.col("text"))
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), text.alias("norm"), F.unhex(F.sha2(text, 256)).alias("digest"))
    held = texts.join(rows.where("n > 1"), ["id", "digest"])
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    own = F.array(F.pmod(F.xxhash64("id", "digest"), salts).cast("int"))
    salted = held.withColumn("salt", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), salts - 1)).otherwise(own)))
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("norm") / chunk_bytes).cast("int") - 1, F.lit(0)))
    cut = salted.withColumn("k", F.explode(places)).withColumn("part", F.substring("norm", F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes))).drop("norm")
    leader = F.first("part").over(Window.partitionBy("print", "salt", "k").orderBy(F.col("leads").desc()))
    return stored_counting(cut.withColumn("same", F.col("part") == leader).where(~F.col("same")).select("id", "digest", "print").distinct())


def exact_duplicates(docs: DataFrame, moduli: tuple[int, ...] = MODULI, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    spark = docs.sparkSession
    prints = fingerprints(docs, moduli, chunk_bytes)
    groups = stored(prints.groupBy("print").agg(F.count("*").alias("n"), _first()).where("n > 1"))
    id = F.coalesce("doc_id", F.lit(-1)).alias("id")
    lead = (F.col("rid") == F.col("first.rid")).alias("leads")
    open_rows = stored(_joined(prints, groups, "print", "inner").select(id, "digest", "print", "n", lead).groupBy("id", "digest", "print").agg(F.max("n").alias("n"), F.max("leads").alias("leads")))
    rounds: list[DataFrame] = []
    while True:
        with_runtime_filter = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
        before = {k: spark.conf.get(k, None) for k in with_runtime_filter}
        for k, v in with_runtime_filter.items():  # texts that no group needs stay out of the shuffle
            spark.conf.set(k, v)
        try:
            other, n = _different(docs, open_rows, chunk_bytes)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        if not n:
            break
        rounds.append(other)
        named = other.withColumn("order", F.struct("id", "digest"))
        leaders = stored(named.groupBy("print").agg(F.count("*").alias("n"), F.min("order").alias("order")).withColumnRenamed("order", "lead"))
        open_rows = stored(_joined(named, leaders, "print", "inner").select("id", "digest", "print", "n", (F.col("order") == F.col("lead")).alias("leads")))
    if rounds:  # texts that share a fingerprint and differ: the number of times that a text differed tells it apart
        times = reduce(DataFrame.unionByName, rounds).groupBy("id", "digest", "print").agg(F.count("*").alias("times"))
        numbered = prints.withColumn("id", id).join(times, ["id", "digest", "print"], "left").drop("id")
        prints = stored(numbered.withColumn("print", F.struct("print", F.coalesce("times", F.lit(0)).alias("times"))).drop("times"))
        groups = stored(prints.groupBy("print").agg(F.count("*").alias("n"), _first()).where("n > 1"))
    many = F.col("n").isNotNull()
    return _joined(prints, groups, "print", "left").select(
        "doc_id",
        F.when(many, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they are."""
    kept = exact_duplicates(docs).where("kept").select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("text_sha256").alias("_digest"))
    own = set_aside(docs, "doc_id", "text").select("row", F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.sha2(normalised_column(F.col("text")), 256).alias("_digest"))
    keys = ["_id", "_null", "_digest"]
    return brought_back(own.join(kept, keys, "left_semi").dropDuplicates(keys), docs.columns)
