"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct five-word shingles. Each permutation keeps
both its smallest and its largest value, so half the hash evaluations give a
signature of the same length; both match with the probability of the sets'
similarity. Signatures are banded, documents that share a band are candidates,
and links are confirmed on full sets.

No group's pairs are all emitted. Documents with equal sets are one node from
the start. In a band's bucket every node is first compared with one leader.
Where a bucket's nodes are then not all in one component, those outside its
largest component meet all of that component, and each other, in blocks of
``BLOCK`` nodes: a task holds one block's sets and streams the others past it,
and only confirmed links come out. So each pair in a bucket is compared or
already joined by other links, and nothing is lost to a cap. Components come
from repeated joins over confirmed links, in the shared folder, never on the
driver.

With 32 bands of 4 values a pair at similarity 0.75 shares no band once in
200,000 times; a pair is not fetched for confirmation if its sizes rule it out
or if its 128 one-byte signature values agree in less than half the places
(more than six standard deviations below 0.75).

Defined results: a text without words, or null, has an empty set and no links;
with one to four words the whole sequence is the only shingle; repeated rows and
doc_ids are linked as any equal texts; a null doc_id is never a component's id
unless all are null; an empty table gives no rows; long texts are taken whole;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brought_back, map_rows, partitions, set_aside, spread_join, stored, stored_counting, with_bytes

SHINGLE, BANDS, ROWS = 5, 32, 4
PERMUTATIONS = BANDS * ROWS // 2
#: similarity in percent
SIMILARITY = 75
#: nodes of one block when outsiders meet a component
BLOCK = 256

_FOLD = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_seeds = np.random.default_rng(20240607)
_BYTE = _seeds.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _seeds.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_ODD = _seeds.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP ** k and its inverse modulo 2 ** 64, for k < n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a folded text."""
    codes = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(codes) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(codes, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(raw: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a folded text."""
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return words
    width = min(SHINGLE, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(_STEP) + words[k : n - width + 1 + k]
    found = mix(total)
    found.sort()
    return found[np.append(True, found[1:] != found[:-1])]


def fold(text: bytes) -> bytes:
    """Words in lower case with single spaces: all that a set depends on."""
    folded = text.translate(_FOLD)
    return b" ".join(folded.split()) if b"  " in folded else folded


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) of each permutation for non-empty sets, each PERMUTATIONS x sets."""
    low = np.empty((PERMUTATIONS, len(sets)), np.uint64)
    high = np.empty_like(low)
    at = 0
    while at < len(sets):  # some tens of thousands of hashes at a time stay in the processor's cache
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= 32768):
            size += len(sets[stop])
            stop += 1
        hashes = np.concatenate(sets[at:stop])
        offsets = np.cumsum([0] + [len(s) for s in sets[at : stop - 1]])
        for k in range(PERMUTATIONS):
            values = (hashes ^ _XOR[k]) * _ODD[k]
            low[k, at:stop] = np.minimum.reduceat(values, offsets)
            high[k, at:stop] = np.maximum.reduceat(values, offsets)
        at = stop
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """BANDS x sets keys; a band has two minima and two maxima of four permutations."""
    out = np.empty((BANDS, low.shape[1]), np.uint64)
    for b in range(BANDS):
        key = np.full(low.shape[1], b + 1, np.uint64)
        for values, k in ((low, 2 * b), (low, 2 * b + 1), (high, 2 * b + 2), (high, 2 * b + 3)):
            key = mix(key * np.uint64(_STEP) + values[k % PERMUTATIONS])
        out[b] = key
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= SIMILARITY * (len(a) + len(b) - shared)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set, band keys, one byte of each signature value, packed folded text."""

    def run(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for doc_ids, text_keys, raws in chunks:
            folded = [fold(r) for r in raws]
            sets = [shingle_set(r) for r in folded]
            n = len(sets)
            out: dict[str, list] = {"doc_id": doc_ids, "text_key": text_keys, "n_shingles": list(map(len, sets)), "digest": [None] * n, "bands": [None] * n, "sig": [None] * n, "folded": [None] * n}
            full = [k for k in range(n) if len(sets[k])]
            if full:
                low, high = signatures([sets[k] for k in full])
                keys = bands(low, high).T.astype(np.int64)
                bytes_ = mix(np.concatenate([low, high]).T) >> np.uint64(56)  # mixed: the top bytes of extremes are alike for all long texts
                for row, k in enumerate(full):
                    codes = sets[k]
                    sums = [int(np.bitwise_xor.reduce(mix(codes + np.uint64(s)))) & (2**64 - 1) for s in (1, 2)]
                    out["digest"][k] = sums[0].to_bytes(8, "little") + sums[1].to_bytes(8, "little") + len(codes).to_bytes(4, "little")
                    out["bands"][k] = keys[row]
                    out["sig"][k] = bytes_[row].astype(np.uint8).tobytes()
                    out["folded"][k] = len(folded[k]).to_bytes(8, "little") + pa.compress(folded[k], codec="zstd", asbytes=True)
            yield out

    source = with_bytes(docs).withColumn("text_key", F.xxhash64("raw"))
    return map_rows(source, ["doc_id", "text_key", "raw"], run, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sig binary, folded binary")


def _unpacked(blob: bytes) -> np.ndarray:
    return shingle_set(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def confirmed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose full sets are similar; ``nodes`` has node, n_shingles, sig, folded."""

    def near(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for a, b, sig_a, sig_b in chunks:
            agree = [np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in zip(sig_a, sig_b)]
            keep = [k for k, x in enumerate(agree) if 2 * x >= len(sig_a[k])]
            yield {"a": [a[k] for k in keep], "b": [b[k] for k in keep]}

    def exact(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for a, b, texts_a, texts_b in chunks:
            seen: dict[int, np.ndarray] = {}  # of one chunk, whose texts are bounded
            keep = []
            for k in range(len(a)):
                for node, blob in ((a[k], texts_a[k]), (b[k], texts_b[k])):
                    if node not in seen:
                        seen[node] = _unpacked(blob)
                if similar(seen[a[k]], seen[b[k]]):
                    keep.append(k)
            yield {"a": [a[k] for k in keep], "b": [b[k] for k in keep]}

    side = lambda s, *cols: nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in cols))
    sized = pairs.join(side("a", "n_shingles", "sig"), "a").join(side("b", "n_shingles", "sig"), "b")
    low, high = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    worth = map_rows(sized.where(100 * low >= SIMILARITY * high), ["a", "b", "sig_a", "sig_b"], near, "a long, b long")
    # the leader's side first: its texts are dealt on with each pair, by the other side
    texts = worth.join(side("a", "folded"), "a").join(side("b", "folded"), "b")
    return map_rows(texts, ["a", "b", "folded_a", "folded_b"], exact, "a long, b long")


def meet(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels (a, b) that a link joins, found in groups; ``rows``: part, place, block, target, node, label.

    Within a group each other node is compared with the targets of other labels,
    and its label is linked with each that has a similar one, once in a group.
    """
    from ..session import ship

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, targets, index, told = None, [], None, set()
        for batch in batches:
            a, b = [], []
            for part, place, block, target, label, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, place, block) != group:
                    group, targets, index, told = (part, place, block), [], None, set()
                if target:
                    targets.append((label, _unpacked(blob)))
                elif targets:
                    index = index or _Block(targets)
                    for other in index.links(label, _unpacked(blob)):
                        if (other, label) not in told:
                            told.add((other, label))
                            a.append(other)
                            b.append(label)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ship(rows.sparkSession)
    key = ["part", "place", "block"]
    dealt = rows.join(nodes.select("node", "folded"), "node").repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key, F.desc("target"), "node")
    return dealt.select(*key, "target", "label", "folded").mapInArrow(run, "a long, b long")


class _Block:
    """Where each shingle of some sets is found."""

    def __init__(self, targets: list[tuple[int, np.ndarray]]) -> None:
        self.labels = np.array([t[0] for t in targets])
        self.sizes = np.array([len(t[1]) for t in targets])
        hashes, owners = np.concatenate([t[1] for t in targets]), np.repeat(np.arange(len(targets)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.owners, hashes = owners[order], hashes[order]
        self.first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        self.known, self.counts = hashes[self.first], np.diff(np.append(self.first, len(hashes)))

    def links(self, label: int, own: np.ndarray) -> list[int]:
        """The other labels that have a similar set."""
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = at[self.known[at] == own]
        counts = self.counts[at]
        places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[at], counts)
        shared = np.bincount(self.owners[places], minlength=len(self.sizes))
        near = np.flatnonzero((100 * shared >= SIMILARITY * (self.sizes + len(own) - shared)) & (self.labels != label))
        return np.unique(self.labels[near]).tolist()


def blocks_of(targets: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows for ``meet``: targets (part, place, node, label) dealt over blocks, and each probe of their place to all blocks."""
    key = ["part", "place"]
    sizes = targets.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = targets.join(sizes, key).select(*key, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("target"), "node", "label")
    sent = probes.join(sizes, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("target"), "node", "label")
    return dealt.union(sent)


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of every node that has a link."""
    both = stored(links.union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        # each node hears its neighbours' labels beside its own, and goes on to the label of the smallest
        told = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        heard = told.union(labels.select("node", "label", F.col("label").alias("own"))).groupBy("node").agg(F.min("label").alias("next"), F.min("own").alias("own"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("root"))
        step = heard.join(jump, "next", "left").select("node", F.least("next", F.coalesce("root", "next")).alias("label"), "own")
        new, moved = stored_counting(step, F.col("label") != F.col("own"))
        labels = new.select("node", "label")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; and text_key and group, for ``deduplicated``."""
    rows = stored(sketch(docs).withColumn("row", F.monotonically_increasing_id()))
    # a node for each distinct set
    sets = stored(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))

    heads = stored(rows.select("row", "bands").join(sets.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"))
    members = heads.select("node", F.explode("bands").alias("band"))
    leaders = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1"))
    buckets = stored(spread_join(members, leaders, "band"))
    wanted = buckets.select(F.col("node").alias("row")).distinct()
    nodes = stored(rows.join(wanted, "row", "left_semi").select(F.col("row").alias("node"), "n_shingles", "sig", "folded"))

    links = stored(confirmed(buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes))
    labels = components(links)
    named = stored(nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    labelled = buckets.select("band", "node").join(named, "node")
    main = labelled.groupBy("band", "label").count().groupBy("band").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("count", "label"))["label"].alias("main")).where("labels > 1")
    outside, some = stored_counting(labelled.join(main, "band").where("label <> main").select("band", "node", "label", "main", (F.col("labels") > 2).alias("several")))
    joined = None
    if some:
        # those outside the same bucket's largest component meet all of it, and each other
        probes = outside.select(F.lit(0).alias("part"), F.col("main").alias("place"), "node", "label").distinct()
        among = outside.where("several").select(F.lit(1).alias("part"), F.col("band").alias("place"), "node", "label")
        targets = named.join(probes.select(F.col("place").alias("label")).distinct(), "label", "left_semi").select(F.lit(0).alias("part"), F.col("label").alias("place"), "node", "label")
        found, some = stored_counting(meet(blocks_of(stored(targets.union(among)), stored(probes.union(among))), nodes).distinct())
        if some:
            joined = components(found)  # of labels, each standing for its whole component

    # the smallest doc_id of each component, for labels, then for nodes, then for rows
    of_nodes = stored(sets.join(named, "node", "left").select("digest", "least", "n", F.coalesce("label", "node").alias("group")))
    smallest = stored(of_nodes.groupBy("group").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).withColumn("root", F.col("group")))
    if joined is not None:
        rooted = stored(smallest.drop("root").join(joined.select(F.col("node").alias("group"), F.col("label").alias("root")), "group", "left").withColumn("root", F.coalesce("root", "group")).withColumnRenamed("n", "nodes"))
        roots = stored(rooted.groupBy("root").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
        smallest = stored(spread_join(rooted.drop("component_id"), roots, "root").select("group", "root", "component_id", F.col("nodes").alias("n")))
    answers = stored(spread_join(of_nodes.withColumnRenamed("n", "rows"), smallest, "group").select("digest", F.col("root").alias("group"), "component_id", F.col("rows").alias("n")))
    own = rows.select("doc_id", "text_key", "n_shingles", "digest", "row")
    full = spread_join(own.where("n_shingles > 0"), answers, "digest").select("doc_id", "text_key", "n_shingles", "group", "component_id")
    empty = own.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("row").alias("group"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "group")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one row of each group: that with the smallest doc_id (null last).

    Rows that agree in doc_id and text are one row, also where texts are empty.
    """
    text_id = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    found = near_duplicates(docs).withColumn("id", text_id(F.col("doc_id")))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "id")).alias("first"))
    winners = first.select("first.id", F.col("first.text_key").alias("key"))
    keyed = set_aside(docs, "doc_id", "text").select("row", text_id(F.col("doc_id")).alias("id"), F.xxhash64(text_id(F.col("text")).cast("binary")).alias("key"))
    return brought_back(keyed.join(winners, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]), docs.columns)
