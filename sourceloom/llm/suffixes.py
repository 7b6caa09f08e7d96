"""Exact removal of repeated substrings by bucket-pointer refinement.

Each byte covered by a ``LENGTH``-byte string that also starts in a document with
a smaller doc_id is removed; strings are judged on the input.

Sorting all suffixes of a corpus moves it many times over, so buckets are made
coarse first and refined only where they hold several documents:

1. Of the q-grams in each string, one is the string's anchor: the one with the
   least hash. Equal strings have equal anchors, at the same place. Strings with
   one anchor stand together; their anchor's q-gram is their initial bucket, and
   the bytes that they cover are the bucket's context there.
2. Per task, only the smallest doc_id of each (q-gram, context) goes on; others
   are repeats already, so no frequent passage reaches one task in many copies.
   After the shuffle by q-gram, contexts found in a smaller document are repeats.
   Of different contexts, only those can share a string that also agree in the
   ``SIDE`` bytes before or after the q-gram, as a string reaches that far to one
   side; in a large corpus most q-grams meet by chance, and these end here. Where
   the q-gram stands in a context twice, its whole bucket goes on.
3. Buckets with several such contexts are refined byte by byte: suffixes of the
   contexts are put in buckets by their first 8 bytes, then sorted on pairs of
   bucket identifiers, their own and that at a later offset, whose refined
   identifiers are written back and used again for 16, 32 and then LENGTH bytes.
   Only places that still share a bucket are sorted in the next round.

A context is told by 96 bits of hash and its part; step 3 compares bytes.

Defined results: a null or empty text has nothing to remove; repeated rows (one
doc_id, any text) never remove each other; rows with a null doc_id are kept
whole and remove nothing; texts shorter than LENGTH are kept; long texts are
taken whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import BATCH_BYTES, map_rows, partitions, stored, with_bytes
from .neardup import _BYTE, mix, powers

LENGTH, GRAM = 50, 16
#: strings of one context at most; a run of equal q-grams has several contexts
MOST_STARTS = LENGTH - GRAM + 1
#: bytes that a string has before or after its q-gram, whichever is more, at least
SIDE = (LENGTH - GRAM) // 2
#: in the byte of an anchor's string count: the q-gram is there twice
TWICE = 128
#: parts of the q-grams' range for each shuffle partition, so that one part is small
PARTS = 4
#: bytes of text whose anchors are dealt out at a time
GATHER_BYTES = 16 << 20
#: repeats that one row holds
FLAGS = 1 << 16

_HASHES = np.dtype([("gram", "<u4"), ("context", "u1", 6), ("left", "<u2"), ("right", "<u2")])


def _starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return base, np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(base))


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """gram (hash), context (hash), doc (index), start, starts of each group of strings with one anchor.

    left, right: a hash of the SIDE bytes before and after the q-gram, 0 where the context ends before; twice: the q-gram is there twice.
    """
    base, doc = _starts(texts)
    codes = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(codes), LENGTH - GRAM + 1
    if n < LENGTH:
        return {k: np.zeros(0, t) for k, t in (("gram", np.uint64), ("context", np.uint64), ("doc", np.int64), ("start", np.int64), ("starts", np.int64), ("left", np.uint16), ("right", np.uint16), ("twice", bool))}
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # the least of each ``width`` grams, from running minima to either side of block borders
    strings = n - LENGTH + 1
    square = np.concatenate([grams, np.full(-len(grams) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:strings], ahead[width - 1 : width - 1 + strings])
    inside = doc[:strings] == doc[LENGTH - 1 : LENGTH - 1 + strings]
    turn = np.append(True, (least[1:] != least[:-1]) | (doc[1:strings] != doc[: strings - 1]))
    first = np.flatnonzero(turn & inside)
    ends = np.minimum(np.append(np.flatnonzero(turn), strings)[np.searchsorted(np.flatnonzero(turn), first) + 1], base[doc[first] + 1] - LENGTH + 1)
    sizes = ends - first
    if sizes.max(initial=0) > MOST_STARTS:
        parts = -(-sizes // MOST_STARTS)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, ends = np.repeat(first, parts) + step * MOST_STARTS, np.repeat(ends, parts)
        sizes = np.minimum(ends - first, MOST_STARTS)
    ends = first + sizes
    context = mix((sums[ends + LENGTH - 1] - sums[first]) * down[first] + sizes.astype(np.uint64))
    # where the q-gram stands: in the first string's window at least once
    gram, place, count = least[first], np.zeros(len(first), np.int64), np.zeros(len(first), np.int8)
    for k in range(LENGTH - GRAM + MOST_STARTS):
        rows = np.flatnonzero(sizes > k - width + 1) if k >= width else slice(None)
        hit = grams[first[rows] + k] == gram[rows]
        count[rows] += hit
        if k < width:
            place[hit] = first[hit] + k
    twice = count > 1
    side = lambda ok, a: np.where(ok & ~twice, 1 + mix((sums[np.where(ok, a + SIDE, SIDE)] - sums[np.where(ok, a, 0)]) * down[np.where(ok, a, 0)]) % np.uint64(2**16 - 1), 0).astype(np.uint16)
    left, right = side(place - SIDE >= first, place - SIDE), side(place + GRAM + SIDE <= ends + LENGTH - 1, place + GRAM)
    return {"gram": gram, "context": context, "doc": doc[first].astype(np.int64), "start": first - base[doc[first]], "starts": sizes, "left": left, "right": right, "twice": twice}


def may_share(gram: np.ndarray, context: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which contexts may share a string with another context of their q-gram in another document."""
    out = np.isin(gram, gram[twice])
    for side in (left, right):
        some = np.flatnonzero(side)
        some = some[np.lexsort((context[some], side[some], gram[some]))]
        if len(some):
            new = np.append(True, (gram[some][1:] != gram[some][:-1]) | (side[some][1:] != side[some][:-1]))
            heads, group = np.flatnonzero(new), np.cumsum(new) - 1
            others = new | np.append(True, context[some][1:] != context[some][:-1])
            apart = np.minimum.reduceat(ids[some], heads) < np.maximum.reduceat(ids[some], heads)
            out[some] |= ((np.bincount(group[others]) > 1) & apart)[group]
    return out


def repeated(texts: list[bytes], docs: np.ndarray, valid: list[np.ndarray]) -> list[np.ndarray]:
    """Which LENGTH-byte strings of some byte runs also start in a run of a smaller document.

    ``valid`` has each run's string starts. A place's bucket is told by the rank
    of the bucket's first place. Each round sorts only the places that share
    their bucket with others, by their bucket and that of a later offset, and
    writes the refined identifiers back, for the next round to use; places alone
    in a bucket keep theirs. Returns a mask over each run's starts.
    """
    base, _ = _starts(texts)
    codes = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    n = len(codes) - 8
    # initial buckets: the first 8 bytes, as a number
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | codes[k : k + n].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    bucket, shared = _numbered(np.append(True, head[order][1:] != head[order][:-1])[:n], np.zeros(n, np.int64), np.arange(n))
    pointer = np.empty(n, np.int64)
    pointer[order] = bucket
    open_ = order[shared]
    for done in (8, 16, 32):
        later = pointer[np.minimum(open_ + min(done, LENGTH - done), n - 1)]
        at = np.lexsort((later, pointer[open_]))
        open_, later = open_[at], later[at]
        old = pointer[open_]
        parted = np.append(True, old[1:] != old[:-1])[: len(old)]
        turn = parted | np.append(True, later[1:] != later[:-1])[: len(old)]
        firsts = np.maximum.accumulate(np.where(parted, np.arange(len(old)), 0))
        pointer[open_], shared = _numbered(turn, old - firsts, np.arange(len(old)))
        open_ = open_[shared]
    starts = np.concatenate([b + v for b, v in zip(base, valid)]).astype(np.int64)
    owner = np.repeat(docs, [len(v) for v in valid])
    keys, where = np.unique(pointer[starts], return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, where, owner)
    return np.split(owner > least[where], np.cumsum([len(v) for v in valid])[:-1])


def _numbered(turn: np.ndarray, base: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted places, where ``turn`` says that a bucket begins: each one's bucket, and whether others share it."""
    first = np.maximum.accumulate(np.where(turn, index, 0)) if len(index) else index
    sizes = np.diff(np.append(np.flatnonzero(turn), len(index)))
    return base + first, np.repeat(sizes, sizes) > 1


def _by_doc(rows: Iterator[tuple]) -> dict[tuple, list[tuple]]:
    out: dict[tuple, list[tuple]] = {}
    for key, span in rows:
        out.setdefault(key, []).append(span)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return with_bytes(docs).withColumn("text_key", F.hash("raw"))


def _grouped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(part, payloads)`` for each part in turn, after a shuffle by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield from fn(now, held)
                    held = []
                now = part
                held.append(payload)
        if held:
            yield from fn(now, held)

    ship(df.sparkSession)
    return df.repartition(partitions(df.sparkSession), "part").sortWithinPartitions("part").select("part", "payload").mapInArrow(run, schema)


def _emit(flags: dict[tuple, list], asks: dict[tuple, list]) -> pa.RecordBatch:
    keys = [(k, False) for k in flags] + [(k, True) for k in asks]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([k[0] for k, _ in keys], pa.int64()),
            "text_key": pa.array([k[1] for k, _ in keys], pa.int32()),
            "ask": pa.array([ask for _, ask in keys], pa.bool_()),
            "spans": pa.array([np.array(asks[k] if ask else flags[k], "<i4").tobytes() for k, ask in keys], pa.binary()),
        }
    )


_CONTROL = "doc_id long, text_key int, ask boolean, spans binary"


def first_buckets(docs: DataFrame, gather_bytes: int = GATHER_BYTES) -> DataFrame:
    """Steps 1 and 2: repeats of whole contexts (start, end), and contexts to refine (part, start, end)."""
    parts = PARTS * partitions(docs.sparkSession)

    def spread(chunks: Iterator[list[list]]) -> Iterator[dict]:
        held, size = [], 0
        for doc_ids, keys, raws in chunks:
            held.append((np.array(doc_ids, np.int64), np.array(keys, np.int64), anchors(raws)))
            size += sum(map(len, raws))
            if size >= gather_bytes:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    def dealt(held: list[tuple]) -> Iterator[dict]:
        """Anchors of some chunks by part: the more at a time, the less is said twice where there are many parts."""
        ids, text_keys = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.lexsort((text_keys, ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids, text_keys = ids[order], text_keys[order]
        bases = np.cumsum([0, *(len(h[0]) for h in held)])
        found = {k: np.concatenate([h[2][k] for h in held]) for k in ("gram", "context", "start", "starts", "left", "right", "twice")}
        found["doc"] = rank[np.concatenate([h[2]["doc"] + base for h, base in zip(held, bases)])]
        gram, context, doc = found["gram"], found["context"], found["doc"]
        at = np.lexsort((doc, context, gram))
        new = np.append(True, (gram[at][1:] != gram[at][:-1]) | (context[at][1:] != context[at][:-1]))[: len(at)]
        leader = doc[at][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(at) else doc
        behind = np.zeros(len(at), bool)
        behind[at] = ids[doc[at]] > ids[leader]
        out: dict[str, list] = {"part": [], "payload": []}
        flags = np.flatnonzero(behind)
        for a in range(0, len(flags), FLAGS):
            some = flags[a : a + FLAGS]
            rows = np.stack([ids[doc[some]], text_keys[doc[some]], found["start"][some], found["start"][some] + found["starts"][some] - 1 + LENGTH], axis=1)
            # repeats found here ride along, by document
            out["part"].append(-1 - int(rows[0, 0]) % parts)
            out["payload"].append(pa.compress(rows.astype("<i8").tobytes(), codec="zstd", asbytes=True) + len(rows).to_bytes(8, "little"))
        send = np.flatnonzero(~behind)
        part = (gram[send] >> np.uint64(40)) % np.uint64(parts)
        send = send[np.argsort(part, kind="stable")]
        cuts = np.searchsorted(np.sort(part), np.arange(parts + 1).astype(np.uint64))
        packed = np.zeros(len(send), _HASHES)
        packed["gram"] = gram[send] & np.uint64(2**32 - 1)
        packed["context"] = context[send].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        packed["left"], packed["right"] = found["left"][send], found["right"][send]
        start, starts = found["start"][send].astype("<i4"), (found["starts"][send] + TWICE * found["twice"][send]).astype("u1")
        size = 0
        for p in range(parts):
            some = packed[cuts[p] : cuts[p + 1]]
            if len(some):
                used, own = np.unique(doc[send[cuts[p] : cuts[p + 1]]], return_inverse=True)
                # hashes don't compress; places, lengths and steps between ids do
                small = pa.compress(np.diff(ids[used], prepend=0).tobytes() + b"".join(x.tobytes() for x in (own.astype("<i4"), start[cuts[p] : cuts[p + 1]], starts[cuts[p] : cuts[p + 1]])), codec="zstd", asbytes=True)
                head = np.array([len(some), len(used), len(small)], "<i8").tobytes()
                out["part"].append(p)
                out["payload"].append(head + text_keys[used].astype("<i4").tobytes() + small + some.tobytes())
                size += len(out["payload"][-1])
                if size >= BATCH_BYTES:
                    yield out
                    out, size = {"part": [], "payload": []}, 0
        if out["part"]:
            yield out

    def unpack(payloads: list[bytes]) -> dict[str, np.ndarray]:
        cols: dict[str, list] = {k: [] for k in ("gram", "context", "left", "right", "id", "key", "start", "starts", "twice")}
        for blob in payloads:
            n, used, small = np.frombuffer(blob, "<i8", 3)
            at = 24
            keys = np.frombuffer(blob, "<i4", used, at)
            at += 4 * used
            rest = pa.decompress(blob[at : at + small], 8 * used + 9 * n, codec="zstd", asbytes=True)
            ids = np.cumsum(np.frombuffer(rest, "<i8", used))
            doc, start, starts = (np.frombuffer(rest, kind, n, 8 * used + skip * n) for kind, skip in (("<i4", 0), ("<i4", 4), ("u1", 8)))
            at += small
            hashes = np.frombuffer(blob, _HASHES, n, at)
            # the sides tell contexts apart as well, so two bytes of a context's hash come from them
            context = np.zeros((n, 8), np.uint8)
            context[:, :6], context[:, 6:] = hashes["context"], (hashes["left"] * np.uint16(40503) + hashes["right"]).astype("<u2").view(np.uint8).reshape(-1, 2)
            for k, v in (("gram", hashes["gram"]), ("context", context.view("<u8").ravel()), ("left", hashes["left"]), ("right", hashes["right"]), ("id", ids[doc]), ("key", keys[doc]), ("start", start), ("starts", starts % TWICE), ("twice", starts >= TWICE)):
                cols[k].append(v)
        return {k: np.concatenate(v) for k, v in cols.items()}

    def gather(part: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if part < 0:
            for blob in payloads:
                rows = np.frombuffer(pa.decompress(blob[:-8], 32 * int.from_bytes(blob[-8:], "little"), codec="zstd", asbytes=True), "<i8").reshape(-1, 4)
                yield _emit(_by_doc(((int(r[0]), int(r[1])), (int(r[2]), int(r[3]))) for r in rows), {})
            return
        c = unpack(payloads)
        at = np.lexsort((c["id"], c["context"], c["gram"]))
        gram, context, ids = c["gram"][at], c["context"][at], c["id"][at]
        grams = np.append(True, gram[1:] != gram[:-1])
        pairs = grams | np.append(True, context[1:] != context[:-1])
        least = ids[np.flatnonzero(pairs)[np.cumsum(pairs) - 1]]
        group = np.cumsum(grams) - 1
        contexts = np.bincount(group[pairs])[group]
        low = np.minimum.reduceat(ids, np.flatnonzero(grams))[group]
        high = np.maximum.reduceat(ids, np.flatnonzero(grams))[group]
        flag, ask = ids > least, np.flatnonzero((ids == least) & (contexts > 1) & (low < high))
        ask = ask[may_share(gram[ask], context[ask], ids[ask], *(c[k][at[ask]] for k in ("left", "right", "twice")))]
        start, end, keys = c["start"][at], c["start"][at] + c["starts"][at].astype(np.int64) - 1 + LENGTH, c["key"][at]
        flags = _by_doc(((int(ids[k]), int(keys[k])), (int(start[k]), int(end[k]))) for k in np.flatnonzero(flag))
        asks = _by_doc(((int(ids[k]), int(keys[k])), (part, int(start[k]), int(end[k]))) for k in ask)
        yield _emit(flags, asks)

    source = _keyed(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("raw") >= LENGTH))
    return _grouped(map_rows(source, ["doc_id", "text_key", "raw"], spread, "part int, payload binary"), gather, _CONTROL)


def refined(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Step 3: repeats inside the contexts that ``asked`` (doc_id, text_key, spans) names."""
    wanted = asked.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"))

    def cut(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for doc_ids, keys, raws, lists in chunks:
            parts: dict[int, list] = {}
            for doc_id, key, raw, blobs in zip(doc_ids, keys, raws, lists):
                for part, start, end in np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 3).tolist():
                    parts.setdefault(part, []).append((doc_id, key, start, raw[start:end]))
            out: dict[str, list] = {"part": [], "payload": []}
            for part, rows in parts.items():
                numbers = np.array([(r[0], r[1], r[2], len(r[3])) for r in rows], "<i8")
                out["part"].append(part)
                body = numbers.tobytes() + b"".join(r[3] for r in rows)
                out["payload"].append(np.array([len(rows), len(body)], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True))
            yield out

    def refine(part: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        numbers, runs = [], []
        for blob in payloads:
            n, size = np.frombuffer(blob, "<i8", 2).tolist()
            body = pa.decompress(blob[16:], size, codec="zstd", asbytes=True)
            some = np.frombuffer(body, "<i8", 4 * n).reshape(n, 4)
            numbers.append(some)
            ends = 32 * n + np.cumsum(some[:, 3])
            runs += [body[e - size : e] for e, size in zip(ends.tolist(), some[:, 3].tolist())]
        rows = np.concatenate(numbers)
        again = repeated(runs, rows[:, 0], [np.arange(size - LENGTH + 1) for size in rows[:, 3].tolist()])
        flags: dict[tuple, list] = {}
        for (doc_id, key, start, _), mask in zip(rows.tolist(), again):
            if mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                flags.setdefault((doc_id, key), []).extend((start + a, start + b - 1 + LENGTH) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
        yield _emit(flags, {})

    texts = _keyed(docs).select("doc_id", "text_key", "raw").join(wanted, ["doc_id", "text_key"])
    return _grouped(map_rows(texts, ["doc_id", "text_key", "raw", "spans"], cut, "part int, payload binary"), refine, _CONTROL)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs: start, end in bytes), kept (the remaining bytes)."""
    control = stored(first_buckets(docs))
    inner = stored(refined(docs, control.where("ask")))
    spans = control.where("not ask").union(inner).groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("found"))

    def cut(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for doc_ids, raws, lists in chunks:
            out: dict[str, list] = {"doc_id": doc_ids, "n_bytes": list(map(len, raws)), "spans": [], "kept": []}
            for raw, blobs in zip(raws, lists):
                runs: list[list[int]] = []
                for a, b in sorted(np.frombuffer(b"".join(blobs or []), "<i4").reshape(-1, 2).tolist()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0] + [x for run in runs for x in run] + [len(raw)]
                out["kept"].append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                out["spans"].append([{"start": a, "end": b} for a, b in runs])
            yield out

    texts = _keyed(docs).select("doc_id", "text_key", "raw").join(spans, ["doc_id", "text_key"], "left")
    return map_rows(texts, ["doc_id", "raw", "found"], cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
