"""Personal data against a plain version with Python's patterns."""

import hashlib
import random
import re

from sourceloom.llm import pii
from sourceloom.llm.queries import op6_pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


def check(rows: list, texts: dict) -> None:
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r.doc_id, joined, r.spans)
        assert [getattr(r, f"n_{k}") for k in pii.KINDS] == [sum(x[2] == k for x in want) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_made_up_texts(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "%d@e.f", "@", "1.2.3.4", ".5.6", "256", "0001", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 555-1234", "+", "()", "é😀", "x", "\n", "9" * 20, "-5", "a.b_c@d-e.fg."]
    texts = {k: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for k in range(1500)} | {1500: None, 1501: ""}
    texts[1502] = "1 " * 30_000  # one match of many digits
    texts[1503] = "a@b.cd " * 3000 + "a" * 100_000 + " " + "1.2.3.4 x " * 500  # long runs and many matches
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pii.report(df).collect(), texts)


def test_registered_query_on_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    check(op6_pii(spark, sf_dir).collect(), texts)


def test_added_spans_and_redaction(spark):
    text = "call +1 (269) 555-3296 4524132264652876 or mail joe (at) site (dot) org, see 2024-01-15 and version 1.2.300.4"
    df = spark.createDataFrame([(1, text, 7), (2, None, 8), (3, "clean", None), (3, "clean", None), (None, "a@b.cd", 1)], "doc_id long, text string, spans int")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert f"phone:{text.index('+1')}:{text.index(' 4524')}" in spans[1].split(",")
    assert spans[2] == spans[3] == ""
    out = pii.redact(df.drop("spans").withColumnRenamed("doc_id", "doc_id"))
    assert out.columns == ["doc_id", "text"]
    texts = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "<null>") for r in out.collect())
    assert [t for _, t in texts][:1] == ["[EMAIL]"] and texts.count(((True, 3), "clean")) == 2
    assert "3296" not in dict((k[1], t) for k, t in texts)[1] and "2024-01-15" in dict((k[1], t) for k, t in texts)[1]
    assert dict((k[1], t) for k, t in texts)[2] == "<null>"


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
