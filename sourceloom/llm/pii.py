"""Personal data by boosted trees over overlapping candidate spans, in SQL functions only.

Generators propose spans: a base pattern for each kind, and looser ones that
also find spans glued to other digits or written apart. Boosted trees score each
candidate on its format and context, and a threshold for each kind, calibrated
for precision, decides. Valid base spans always stay; the method adds others.

The trees are fitted in numpy on the driver, once for each process, on a fixed
number of made-up sentences (TRAIN_ROWS), and are then CASE expressions, so
that finding and redacting run in one narrow pass without Python.

Spans are code points, end exclusive. Defined results: a null or empty text has
no spans; repeated rows are scanned again; a null doc_id stays null; an empty
table gives no rows; texts of any length are scanned whole, by patterns that
neither recurse nor retry a run of characters; other columns, whatever their
names, pass through.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import brought_back, set_aside

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 4000
PRECISION = 0.995
TREES, RATE = 40, 0.3

_NAME = "[A-Za-z0-9._%+-]"
#: kind, pattern, cheap test that a text may hold it, base. A possessive repeat
#: and a start at the head of a run (or right after a match) find what the plain
#: greedy pattern finds, without retrying each place of a long run.
GENERATORS: list[tuple[str, str, str, bool]] = [
    ("email", rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "contains(text, '@')", True),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"text rlike r'[0-9]\.[0-9]'", True),
    ("card", r"[0-9](?:[ -]?[0-9])++", r"text rlike r'[0-9](?:[ -]?[0-9]){12}'", True),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains(text, '+')", True),
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,24}){1,4}", r"text rlike r'[(\[]at[)\]]'", False),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", r"text rlike r'[0-9]\.[0-9]'", False),
    ("card", r"(?<![0-9])[0-9]{14,19}(?![0-9])", r"text rlike r'[0-9]{14}'", False),
    ("card", r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,7}(?![0-9])", r"text rlike r'[0-9]{4}[ -][0-9]{4}[ -]'", False),
    ("phone", r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", "contains(text, '+')", False),
    ("phone", r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"text rlike r'[0-9]{3}[ .-][0-9]{4}'", False),
]

_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
_DIGITS = "regexp_replace(c.txt, '[^0-9]', '')"
#: whether a match of the base pattern is valid
VALID = {
    "email": "true",
    "ip": f"c.txt rlike r'{_OCTETS}'",
    "card": f"length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
_CUES = "(?i)(?:mail|contact|phone|tel|call|mobile|fax|dial|card|visa|credit|pay|host|server|addr|login|ip)[a-z]{0,6}[^A-Za-z0-9]{0,3}$"
#: integer features of a candidate ``c``: txt, before, after
FEATURES = {
    "digits": f"length({_DIGITS})",
    "chars": "length(c.txt)",
    "groups": "regexp_count(c.txt, '[0-9]+')",
    "plus": "cast(startswith(c.txt, '+') as int)",
    "luhn": f"cast(coalesce(luhn_check({_DIGITS}), false) as int)",
    "octets": f"cast(c.txt rlike r'{_OCTETS}' as int)",
    "cue": f"cast(c.before rlike r'{_CUES}' as int)",
    "glued_before": "cast(c.before rlike r'[A-Za-z0-9_.+-]$' as int)",
    "glued_after": "cast(c.after rlike r'^[A-Za-z0-9_]|^[.-][0-9]' as int)",
    "variety": f"size(array_distinct(split({_DIGITS}, '')))",
    "letters": "regexp_count(c.txt, '[A-Za-z]')",
    "marks": r"regexp_count(c.txt, r'[()\[\]@]')",
}
#: candidates of one block when offsets are summed up
BLOCK = 256


def _candidates(kind: str, pattern: str, test: str) -> Column:
    """All candidates of one generator, as an expression over ``text``."""
    raw = F.when(F.expr(test), F.array(F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("p"))))

    def placed(s: Column) -> Column:
        m, p = s["m"], s["p"]
        n = F.size(m)
        parts = F.transform(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)")),
            lambda i: F.struct(F.length(p[i - 1]).alias("a"), F.length(m[i - 1]).alias("b"), m[i - 1].alias("txt"), F.right(p[i - 1], F.lit(24)).alias("before"), F.left(p[i], F.lit(2)).alias("after")),
        )
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(n > 0, _summed(blocks))

    def _summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["a"] + x["b"]))
        firsts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        none = F.expr("cast(array() as array<struct<start:int,end:int,txt:string,before:string,after:string>>)")

        def within(block: Column, first: Column) -> Column:
            return F.aggregate(
                block,
                F.struct(first.alias("at"), none.alias("out")),
                lambda acc, x: F.struct(
                    (acc["at"] + x["a"] + x["b"]).alias("at"),
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + x["a"]).alias("start"), (acc["at"] + x["a"] + x["b"]).alias("end"), x["txt"].alias("txt"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"),
                ),
                lambda acc: acc["out"],
            )

        return F.flatten(F.zip_with(blocks, F.slice(firsts, F.lit(1), F.size(blocks)), within))

    return F.flatten(F.transform(raw, placed))


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add ``g0``, ``g1``, ...: the candidates of each generator (null: the text can't hold any)."""
    source = docs.withColumn("_own", F.col("text")).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return source.withColumns({f"g{k}": _candidates(kind, pattern, test) for k, (kind, pattern, test, _) in enumerate(GENERATORS)})


def _key(kind: str) -> str:
    """A span as one long that sorts by start, kind and length."""
    return f"shiftleft(cast(c.start as bigint), 32) + {KINDS.index(kind)} * shiftleft(1L, 30) + (c.end - c.start)"


class Trees:
    """Boosted trees of two levels on integer features, with thresholds by kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        self.trees: list[tuple] = []
        score = np.full(len(y), self.bias)
        cuts = [np.unique(x[:, f])[:-1] + 0.5 for f in range(x.shape[1])]
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts, 2)
            self.trees.append(tree)
            score += self._apply(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple:
        leaf = (round(RATE * float(g.sum() / (h.sum() + 1.0)), 6),)
        if not depth or len(g) < 20:
            return leaf
        best = (1e-6, None, None)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f, places in enumerate(cuts):
            for cut in places[:: max(1, len(places) // 16)]:
                left = x[:, f] < cut
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
                if gain > best[0]:
                    best = (gain, f, float(cut))
        _, f, cut = best
        if f is None:
            return leaf
        left = x[:, f] < cut
        return (f, cut, self._grow(x[left], g[left], h[left], cuts, depth - 1), self._grow(x[~left], g[~left], h[~left], cuts, depth - 1))

    def _apply(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] < tree[1], self._apply(tree[2], x), self._apply(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._apply(t, x) for t in self.trees)

    def sql(self) -> str:
        names = list(FEATURES)

        def case(tree: tuple) -> str:
            return repr(tree[0]) + "D" if len(tree) == 1 else f"if(f.{names[tree[0]]} < {tree[1]}D, {case(tree[2])}, {case(tree[3])})"

        return " + ".join([repr(self.bias) + "D", *map(case, self.trees)])


def _sentence(rng: random.Random) -> tuple[str, list[tuple[str, str]]]:
    """A made-up sentence, and the (kind, text) spans in it that are personal data."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("456") + digits(14)
        return next(body + c for c in "0123456789" if sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(body + c))) % 10 == 0)

    def grouped(s: str, by: str) -> str:
        return by.join(s[k : k + 4] for k in range(0, len(s), 4))

    area = lambda: rng.choice("23456789") + digits(2)
    good = [
        lambda: ("email", f"{word()}{rng.choice(['', '.', '_'])}{word()}@{word()}.{rng.choice(['com', 'org', 'example.net'])}"),
        lambda: ("email", f"{word()} {rng.choice(['(at)', '[at]'])} {word()} {rng.choice(['(dot)', '[dot]'])} {rng.choice(['com', 'org', 'net'])}"),
        lambda: ("ip", ".".join(str(rng.randint(1, 255)) for _ in range(4))),
        lambda: ("card", card()),
        lambda: ("card", grouped(card(), rng.choice(" -"))),
        lambda: ("phone", f"+{rng.randint(1, 99)} ({area()}) {digits(3)}-{digits(4)}"),
        lambda: ("phone", f"+{rng.randint(1, 99)}{rng.choice(' -.')}{area()}{rng.choice(' -.')}{digits(3)}{rng.choice(' -.')}{digits(4)}"),
        lambda: ("phone", f"({area()}) {digits(3)}-{digits(4)}"),
        lambda: ("phone", f"{area()}-{digits(3)}-{digits(4)}"),
    ]
    bad = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}",
        lambda: f"section {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}",
        lambda: digits(rng.randint(14, 19)),
        lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: grouped(digits(16), rng.choice(" -")),
        lambda: f"part {digits(3)}.{digits(3)}.{digits(4)}.{digits(3)}",
        lambda: f"{word()}{digits(3)}-{digits(3)}-{digits(4)}{rng.choice(['x', '_a', '-99'])}",
        lambda: f"{digits(3)},{digits(3)}.{digits(2)}",
        lambda: f"+{digits(2)} {digits(4)} {digits(4)}",
    ]
    parts, spans = [], []
    for _ in range(rng.randint(1, 3)):
        parts.append(" ".join(word() for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.5:
            kind, text = rng.choice(good)()
            spans.append((kind, text))
            if rng.random() < 0.3:
                parts.append(rng.choice({"email": ["mail", "contact:"], "ip": ["host", "server"], "card": ["card", "visa"], "phone": ["call", "tel.", "phone:"]}[kind]))
        else:
            text = rng.choice(bad)()
        parts.append(text)
        if rng.random() < 0.15:  # personal data right after other digits
            kind, text = rng.choice(good)()
            spans.append((kind, text))
            parts.append(text)
    return " ".join(parts + [word()]), spans


_model: list[tuple[str, dict[str, float]]] = []


def model(spark: SparkSession) -> tuple[str, dict[str, float]]:
    """The trees as SQL over ``f``, and the threshold of each kind."""
    if _model:
        return _model[0]
    rng = random.Random(11)
    made = [_sentence(rng) for _ in range(TRAIN_ROWS)]
    rows = with_candidates(spark.createDataFrame([(k, text) for k, (text, _) in enumerate(made)], "doc_id long, text string"))
    for k, (kind, *_) in enumerate(GENERATORS):
        rows = rows.withColumn(f"g{k}", F.expr(f"transform(g{k}, c -> struct('{kind}' as kind, c.txt as txt, array({', '.join(f'cast({sql} as double)' for sql in FEATURES.values())}) as f))"))
    found = rows.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(*(f"g{k}" for k in range(len(GENERATORS))))))).alias("c")).select("doc_id", "c.kind", "c.txt", "c.f").collect()
    kinds = np.array([KINDS.index(r[1]) for r in found])
    x = np.array([r[3] for r in found])
    y = np.array([(r[1], r[2]) in made[r[0]][1] for r in found], float)
    fit = np.array([r[0] % 2 == 0 for r in found])
    trees = Trees(x[fit], y[fit])
    score, thresholds = trees.score(x), {}
    for k, kind in enumerate(KINDS):
        held = np.flatnonzero(~fit & (kinds == k))
        order = held[np.argsort(-score[held], kind="stable")]
        precision = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        thresholds[kind] = float(score[order[good[-1]]]) if len(good) else math.inf
    _model.append((trees.sql(), thresholds))
    return _model[0]


def find(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``spans`` (sorted arrays of longs, see ``describe``) and ``text`` without null."""
    score, thresholds = model(docs.sparkSession)
    rows = with_candidates(docs)
    base, added = [], []
    features = ", ".join(f"cast({sql} as double) as {name}" for name, sql in FEATURES.items())
    for k, (kind, _, _, is_base) in enumerate(GENERATORS):
        none = "cast(array() as array<bigint>)"
        if is_base:
            base.append(F.expr(f"coalesce(transform(filter(g{k}, c -> {VALID[kind]}), c -> {_key(kind)}), {none})"))
        if math.isfinite(thresholds[kind]):
            scored = f"transform(g{k}, c -> struct(struct({features}) as f, {_key(kind)} as key))"
            added.append(F.expr(f"coalesce(transform(filter(transform({scored}, s -> struct(s.key as key, s.f as f)), s -> {score.replace('f.', 's.f.')} >= {thresholds[kind]!r}D), s -> s.key), {none})"))
    return (
        rows.withColumn("base", F.array_sort(F.concat(*base)))
        .withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", *added))))
        .drop(*(f"g{k}" for k in range(len(GENERATORS))))
    )


def parts_of(spans: str) -> str:
    """Keys as structs (kind, start, end)."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return (
        f"transform({spans}, s -> struct(element_at(array({names}), cast(shiftright(s, 30) & 3 as int) + 1) as kind, "
        f"cast(shiftright(s, 32) as int) as start, cast(shiftright(s, 32) + (s & 1073741823) as int) as end))"
    )


def describe(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({parts_of(spans)}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(docs: DataFrame) -> DataFrame:
    """The documents, with each run of overlapping spans replaced by the first one's kind in brackets."""
    found = find(set_aside(docs, "text")).withColumn("_at", F.expr(parts_of("spans")))
    # overlapping spans become one; spans of one text only are held
    merged = """aggregate(_at, cast(array() as array<struct<kind:string,start:int,end:int>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).end > s.start,
           concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).kind as kind, element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, s.end) as end))),
           concat(acc, array(struct(s.kind as kind, s.start as start, s.end as end)))))"""
    found = found.withColumn("_at", F.expr(merged))
    kept = "transform(_at, (s, i) -> concat(substring(text, if(i = 0, 0, _at[i - 1].end) + 1, s.start - if(i = 0, 0, _at[i - 1].end)), '[', upper(s.kind), ']'))"
    new = F.expr(f"if(size(_at) = 0, _own, concat(array_join({kept}, ''), substring(text, element_at(_at, -1).end + 1)))")
    return brought_back(found, docs.columns, text=new)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    count = lambda k: F.expr(f"cast(size(filter(base, s -> (shiftright(s, 30) & 3) = {k})) as bigint)").alias(f"n_{KINDS[k]}")
    return find(docs.select("doc_id", "text")).select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(describe("base").cast("binary"), 256).alias("base_sha256"), describe("spans").alias("spans"))
