"""Quality rules as a short-circuit cascade.

Every document gets the base measures. The verdict of the other rules comes from
a cascade: what each rule costs beside the measures already made, and what it
rejects of the documents that earlier rules leave, are estimated on a random
sample; rules run in the order of rejections per cost, and a document that one
rule rejects is not shown to the next. The order changes the time only, never a
verdict, as a document is kept when no rule rejects it.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are judged again, alike; a null doc_id stays null; an empty table
gives no rows; texts of any length are measured whole; other columns are not
looked at.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, with_bytes

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: documents, about, on which costs and rejections are estimated
SAMPLE_ROWS = 400


class Measured:
    """Measures of one text, each made when first asked for."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at exactly the six white-space characters of ASCII

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        inside = self.raw.translate(None, SPACE)
        return len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        number = {w: k for k, w in enumerate(dict.fromkeys(self.words))}
        ids = np.fromiter(map(number.__getitem__, self.words), np.int64, n)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 2_000_000:  # so that three numbers fit into 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        again = np.zeros(n, bool)
        starts = order[np.append(same, False) | np.append(False, same)]
        for k in range(3):
            again[starts + k] = True
        return int(again.sum())

    @cached_property
    def case(self) -> tuple[int, int]:
        """Upper-case and lower-case letters of ASCII."""
        codes = np.bincount(np.frombuffer(self.raw, np.uint8), minlength=128)
        return int(codes[65:91].sum()), int(codes[97:123].sum())


#: name: whether the rule rejects. Integers only, so that every engine agrees.
RULES: dict[str, Callable[[Measured], bool]] = {
    "symbols": lambda d: 4 * d.n_symbols > d.n_words,
    "line_repeats": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "word_length": lambda d: d.word_chars > 20 * d.n_words or d.word_chars < 2 * d.n_words,
    "shouting": lambda d: d.case[0] > d.case[1],
    "exclaiming": lambda d: 3 * d.raw.count(b"!") > d.n_words,
}


def base_failed(d: Measured) -> bool:
    return d.n_words < MIN_WORDS or 100 * d.n_repeat_words > 50 * d.n_words


def tried(d: Measured, rules: dict[str, Callable[[Measured], bool]]) -> tuple[list[float], list[bool]]:
    """What each rule costs beside the base measures, and whether it rejects."""
    costs, verdicts = [], []
    for rule in rules.values():
        trial = copy.copy(d)  # leaves no measures behind
        began = time.perf_counter()
        verdicts.append(bool(rule(trial)))
        costs.append(time.perf_counter() - began)
    return costs, verdicts


def order_rules(trials: list[tuple[list[float], list[bool]]], names: list[str]) -> list[str]:
    """Names of the rules, each next one that with most rejections per second on what the former leave."""
    left, order = sorted(range(len(names)), key=names.__getitem__), []
    while left:
        best = max(left, key=lambda k: (sum(v[k] for _, v in trials) + 0.5) / (sum(c[k] for c, _ in trials) + 1e-6))
        order.append(names[best])
        left.remove(best)
        trials = [t for t in trials if not t[1][best]]
    return order


def base_measured(d: Measured) -> bool:
    """Make all base measures; whether the base rules reject."""
    for m in MEASURES:
        getattr(d, m)
    return base_failed(d)


def judge(docs: DataFrame, rules: dict[str, Callable[[Measured], bool]] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base measures, base_failed and kept."""
    rules = RULES if rules is None else rules
    source = with_bytes(docs)
    # a plan, not a verdict: rules are tried on a random sample of about ``sample_rows`` texts, whole and where they are
    rows = max(1, docs.count())

    def trial(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for (raws,) in chunks:
            found = [tried(d, rules) for d in map(Measured, raws) if not base_measured(d)]
            yield {"costs": [c for c, _ in found], "verdicts": [v for _, v in found]}

    trials = map_rows(source.select("raw").sample(False, min(1.0, sample_rows / rows), 11), ["raw"], trial, "costs array<double>, verdicts array<boolean>").collect()
    cascade = [rules[name] for name in order_rules([(r.costs, r.verdicts) for r in trials], list(rules))]

    def run(chunks: Iterator[list[list]]) -> Iterator[dict]:
        for doc_ids, raws in chunks:
            found = [Measured(r) for r in raws]
            out: dict[str, list] = {"doc_id": doc_ids} | {m: [getattr(d, m) for d in found] for m in MEASURES}
            out["base_failed"] = [base_failed(d) for d in found]
            alive = [k for k, failed in enumerate(out["base_failed"]) if not failed]
            for rejects in cascade:
                alive = [k for k in alive if not rejects(found[k])]
            kept = set(alive)
            out["kept"] = [k in kept for k in range(len(found))]
            yield out

    return map_rows(source, ["doc_id", "raw"], run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean")
