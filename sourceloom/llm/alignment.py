"""Alignment of the tokens of two tokenizers by a dangling-suffix transducer.

Both tokenizers cover the same bytes, a space and the text. The transducer reads
the next token of the side that lies behind; its state is which side leads and
by which bytes, the dangling suffix. A transition, memoised by state and token,
either shortens the suffix or turns the lead over; where the suffix becomes empty
both sides have ended together, and a group closes. The last tokens of a group's
sides are linked, as their byte ranges end together.

Texts are cut where neither tokenizer can join what lies on both sides: before a
single space or line feed between other characters. Such units repeat a lot, so
the transducer's output for a unit is kept in a bounded memo, and only unseen
units reach the tokenizers. Whether the piece vocabulary allows these cuts is
looked up in it; if it does not, or where white space meets white space, the
text is not cut there. The groups are the same either way.

Corpus-wide counts are Spark sums over (first id, second id). The HOT_PAIRS most
frequent pairs (a bound, whatever the corpus) are broadcast to the documents'
links; links of all other pairs meet their counts by a shuffle.

Defined results: a null or empty text, and one whose tokens do not spell the
space and the text on both sides, has no tokens: zeros and an empty digest; tokens of
special strings inside texts are plain text; repeated rows count again; a null
doc_id stays null; texts of any length are aligned whole; other columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, map_rows, stored, with_bytes
from .tokens import byte_letters

#: units and transitions kept by a worker process before a memo starts anew, and the longest unit kept
MEMO_UNITS, MEMO_MOVES, MEMO_CHARS = 500_000, 200_000, 64
#: units that the tokenizers get at a time
BATCH = 4096
#: pairs whose counts are broadcast: 24 bytes each
HOT_PAIRS = 1 << 17
#: ids of the second tokenizer are below this in a pair's code
SECOND = 1 << 31

_BETWEEN, _ONE = "\1", struct.Struct("=q")
#: where a text may be cut: before one space or line feed between characters that are no white space
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_BESIDE = re.compile(r"\s\s|^\s|\s$")


class State:
    """Which side leads and by which bytes, so which side reads next; and the states after the tokens read so far."""

    __slots__ = ("lead", "rest", "reader", "moves")

    def __init__(self, lead: int, rest: bytes) -> None:
        self.lead, self.rest, self.reader = lead, rest, 1 - lead if rest else 0
        self.moves: dict[int, State] = {}


class Transducer:
    """States by dangling suffix. Sides are 0 and 1; with an empty suffix the first reads."""

    def __init__(self, spelled: tuple[list[bytes], list[bytes]]) -> None:
        self.spelled = spelled
        self._anew()

    def _anew(self) -> None:
        self.start = State(0, b"")
        self.states = {(0, b""): self.start}
        self.n_moves = 0

    def step(self, state: State, token: int) -> State | None:
        """The state after ``state`` reads ``token``, kept with it; None if the bytes of the sides differ."""
        rest, read = state.rest, self.spelled[state.reader][token]
        if not read:
            return None
        if rest.startswith(read):
            new = (state.lead, rest[len(read) :])
        elif read.startswith(rest):
            new = (state.reader, read[len(rest) :])
        else:
            return None
        new = new if new[1] else (0, b"")
        found = self.states.get(new)
        if found is None:
            found = self.states[new] = State(*new)
        state.moves[token] = found
        self.n_moves += 1
        return found

    def groups(self, first: list[int], second: list[int]) -> list[tuple[int, int]] | None:
        """Where each group ends in either side; None if they spell different bytes."""
        if self.n_moves > MEMO_MOVES:
            self._anew()
        state = start = self.start
        i, j, n, m, out = 0, 0, len(first), len(second), []
        while True:
            if state.reader:
                if j == m:
                    return None
                token = second[j]
                j += 1
            elif i < n:
                token = first[i]
                i += 1
            else:
                return out if state is start and j == m else None
            state = state.moves.get(token) or self.step(state, token)
            if state is start:
                out.append((i, j))
            elif state is None:
                return None


class Aligner:
    """Groups of texts, with the memo of their units."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(bytes_path)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        code = {letter: byte for byte, letter in byte_letters().items()}
        named = {i: t for t, i in self.first.get_vocab().items()}
        spelled = [bytes(code[ord(c)] for c in t) if all(ord(c) in code for c in t) else b"" for t in (named.get(i, "") for i in range(max(named) + 1))]
        pieces = [self.second.id_to_piece(i) for i in range(len(self.second))]
        other = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.transducer = Transducer((spelled, other))
        self.mark = self.second.piece_to_id("▁")
        #: no piece has a space mark after, or a line feed beside, another character; and texts are not normalised
        plain = all(not re.search("[^▁]▁", p) and (p == "\n" or "\n" not in p) for p in pieces)
        probe = " a \n ﬁ½  é\t"
        self.cuts = plain and self.second.decode(self.second.encode("x" + probe)) == "x" + probe and pieces[self.mark] == "▁"
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}

    def _aligned(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Groups as text (``,`` between first ids, an own sign between second ones) and linked pairs of units, each with its first space or line feed; None for one that cannot be aligned."""
        found = []
        firsts = self.first.encode_batch_fast(units, add_special_tokens=False)
        seconds = self.second.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for unit, first, second in zip(units, firsts, seconds):
            if unit[0] != " ":  # the mark that is put before any text
                if not second or second[0] != self.mark:
                    found.append(None)
                    continue
                second = second[1:]
            first = first.ids
            ends = self.transducer.groups(first, second)
            if ends is None:
                found.append(None)
            elif len(ends) == 1:
                found.append(((",".join(map(str, first)) + "|" + _BETWEEN.join(map(str, second))).encode(), _ONE.pack(first[-1] * SECOND + second[-1])))
            else:
                i = j = 0
                texts, links = [], []
                for a, b in ends:
                    texts.append(",".join(map(str, first[i:a])) + "|" + _BETWEEN.join(map(str, second[j:b])))
                    links.append(first[a - 1] * SECOND + second[b - 1])
                    i, j = a, b
                found.append((";".join(texts).encode(), array("q", links).tobytes()))
        return found

    def _units(self, text: str) -> list[str]:
        """The units of a space and the text; a single space before a unit's first character is left out."""
        if not self.cuts:
            return [text]
        if not _BESIDE.search(text):
            return text.replace("\n", " \n").split(" ")
        first, *rest = _CUT.split(" " + text)
        return [first[1:] if first[1:2].strip() else first] + [u[1:] if u[0] == " " else u for u in rest]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, np.ndarray] | None]:
        """n_a, n_b, groups and codes of linked pairs of each text; None where there are none."""
        if len(self.memo) > MEMO_UNITS:
            self.memo = {}
        known, cut = self.memo, [self._units(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(known))
        long = {}
        for at in range(0, len(new), BATCH):
            some = new[at : at + BATCH]
            # a unit keeps its own first character only if that is white space
            for u, x in zip(some, self._aligned([u if u[:1] in ("\n", " ") and self.cuts else " " + u for u in some])):
                (known if len(u) <= MEMO_CHARS else long)[u] = x
        for units in cut:
            found = [known[u] if u in known else long[u] for u in units] if long else list(map(known.__getitem__, units))
            if not found or None in found:
                yield None
                continue
            groups, links = zip(*found)
            groups = b";".join(groups)
            n = groups.count(b";") + 1
            yield n + groups.count(b","), n + groups.count(_BETWEEN.encode()), groups.replace(_BETWEEN.encode(), b","), np.frombuffer(b"".join(links), np.int64)


_open: dict[tuple[str, str], Aligner] = {}
keeps("alignment", _open.clear)


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One for each pair of files and worker process."""
    key = (bytes_path, pieces_path)
    if key not in _open:
        _open[key] = Aligner(*key)
    return _open[key]


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """rid (a number of the row), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with their numbers; stored."""

    def run(chunks: Iterator[list[list]]) -> Iterator[dict]:
        held, rid = aligner(bytes_path, pieces_path), TaskContext.get().partitionId() << 36
        for doc_ids, raws in chunks:
            out: dict[str, list] = {"rid": list(range(rid, rid + len(raws))), "doc_id": doc_ids, "n_a": [], "n_b": [], "n_groups": [], "groups_sha256": [], "pairs": [], "times": []}
            rid += len(raws)
            for found in held.align([r.decode() for r in raws]):
                n_a, n_b, groups, links = found or (0, 0, b"", np.zeros(0, np.int64))
                pairs, times = np.unique(links, return_counts=True)
                out["n_a"].append(n_a)
                out["n_b"].append(n_b)
                out["n_groups"].append(len(links))
                out["groups_sha256"].append(sha256(groups).hexdigest() if found else "")
                out["pairs"].append(pairs)
                out["times"].append(times.astype(np.int32))
            out["n_links"] = out["n_groups"]  # one pair ends each group
            yield out

    fields = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return stored(map_rows(with_bytes(docs), ["doc_id", "raw"], run, fields, "alignment"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, a, b, n (links corpus-wide) and best (whether no pair of its second id has more) of all linked pairs (``pair``, ``times``)."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("a", F.shiftright("pair", 31)).withColumn("b", F.col("pair").bitwiseAND(SECOND - 1))
    counts = stored(counts)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary at most
    return stored(counts.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def token_alignment(docs: DataFrame, bytes_path: str, pieces_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    rows = aligned(docs, bytes_path, pieces_path)
    links = rows.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("rid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = pair_counts(links).select("pair", "n", "best")
    hot = stored(counts.orderBy(F.col("n").desc(), "pair").limit(hot_pairs))
    told = links.join(F.broadcast(hot), "pair")
    if counts.count() > hot_pairs:
        rare = counts.join(hot, "pair", "left_anti")
        told = told.unionByName(links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rare, "pair").select(*told.columns))
    sums = told.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
