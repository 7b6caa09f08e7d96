import pytest

ODD = [
    (1, "one two three four five six seven", "en", 7),
    (1, "one two three four five six seven", "en", 7),  # a repeated row
    (2, None, None, None),
    (3, "", "en", 0),
    (4, " \n\t ", "en", 4),
    (None, "no id here but words enough to count", None, 1),
    (5, "ONE two\tthree four five six SEVEN", "en", 7),
    (6, "é😀 ünï   code", "fr", 5),
    (7, "long " * 60_000, "en", 300_000),
    (8, "<|endoftext|> [INST] </s> a@b.cd", "en", 30),
]


CLASHES = ["base", "g0", "g1", "g7", "_own", "_at", "_id", "_key", "id", "key", "row", "node", "n", "group", "digest", "band", "label", "windows", "rank", "toxic", "piece", "length", "ids", "kept", "a.b"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, lang, "s", n, 1, b"x", "k", 0, *CLASHES) for i, t, lang, n in ODD]
    clashing = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, score int, raw binary, text_key string, spans int, {clashing}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
