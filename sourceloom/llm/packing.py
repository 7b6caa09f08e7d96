"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

The plan works on counts: a sequence only has a remaining room, so sequences
with the same room form one group, and a length with many documents fills whole
groups at a time. The plan has a few rows for each length whatever the corpus
holds, and documents take the planned slots by joining on their rank within
their length.

Defined results: a null or empty text has the terminator as its only token; a
repeated row is packed again as its own document; a null ``doc_id`` stays null;
ties in length take slots by a hash of doc_id, piece and checksum where there
are over SALT_ROWS of them, then by doc_id, piece, checksum and start; an empty
table gives no rows; other columns of the input are not looked at. A document longer than
``capacity`` is cut into pieces of ``capacity`` tokens, any length of text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, stored, with_bytes
from .tokens import tokenizer

#: pieces of one length that one task ranks
SALT_ROWS = 1 << 15


def pieces(docs: DataFrame, path: str, capacity: int = 2048, terminator: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian, 32 bits)."""
    end = np.array([terminator], "<u4").tobytes()

    def cut(chunks: Iterator[list[list]]) -> Iterator[dict]:
        encode = tokenizer(path).encode
        for doc_ids, raws in chunks:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, packed in zip(doc_ids, encode(raws)):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    for name, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None)):
                        out[name].append(value)
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return map_rows(with_bytes(docs), ["doc_id", "raw"], cut, schema, "tokens")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first rank, end of ranks, slots for each sequence, first
    sequence, offset there): rank r of that length goes to sequence
    ``first + (r - rank) // slots`` at ``offset + (r - rank) % slots * length``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms that have groups
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room = capacity
                slots = room // length
                first, n = sequences, -(-left // slots)
                sequences += n
            else:
                room = rooms[at]
                slots = room // length
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            full, rest = divmod(min(left, n * slots), slots)
            if full:
                rows.append((length, rank, rank + full * slots, slots, first, capacity - room))
                put(room - slots * length, first, full)
            if rest:
                rows.append((length, rank + full * slots, rank + full * slots + rest, rest, first + full, capacity - room))
                put(room - rest * length, first + full, 1)
            used = full + bool(rest)
            put(room, first + used, n - used)
            rank += full * slots + rest
            left -= full * slots + rest
    return rows


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (``cut`` must be stored: it is read several times).

    A piece of ``capacity`` tokens is a sequence of its own and needs no rank;
    those have negative numbers.
    """
    spark = cut.sparkSession
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity)
    # at most ``capacity`` rows come to the driver
    histogram = {int(r[0]): int(r[1]) for r in rest.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), "slot_length long, rank_from long, rank_to long, slots long, first_sequence long, slot_offset long")

    # ranks are counted within a length and salt; one task ranks about SALT_ROWS pieces, however many share a length
    parts = spark.createDataFrame([(length, -(-n // SALT_ROWS)) for length, n in histogram.items()], "length long, salts long")
    salted = rest.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    # the plan, some rows for each length, is broadcast; ``base``, which grows with the pieces, is not: both sides lie by length and salt
    ranked = salted.withColumn("own_rank", F.row_number().over(own) - 1).join(base.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own_rank"))
    within = F.col("rank") - F.col("rank_from")
    placed = (
        ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .withColumn("sequence_id", (F.col("first_sequence") + F.floor(within / F.col("slots"))).cast("long"))
        .withColumn("offset", (F.col("slot_offset") + within % F.col("slots") * F.col("length")).cast("long"))
    )
    return placed.select(*cut.columns, "sequence_id", "offset").unionByName(whole)


def pack(docs: DataFrame, path: str, capacity: int = 2048, terminator: int = 0, ids: bool = False) -> DataFrame:
    return place(stored(pieces(docs, path, capacity, terminator, ids)), capacity)
