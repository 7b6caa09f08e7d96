from pyspark.sql import functions as F

from sourceloom.functions import rewrite as rw

TEXTS = {
    "SELECT DECODE(a, 1, 'x', 'y'), decode (b, 2, 'z') FROM t WHERE DECODE(a, 1, 'x', 'y') = 'x'": "SELECT CASE a WHEN 1 THEN 'x' ELSE 'y' END, CASE b WHEN 2 THEN 'z' END FROM t WHERE CASE a WHEN 1 THEN 'x' ELSE 'y' END = 'x'",
    "DECODE(a, f(b), 1) DECODE(a, b) DECODE(c, 1, 2, 3, 4, 5)": "DECODE(a, f(b), 1) DECODE(a, b) CASE c WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 5 END",
    "SELECT '$1 \\' FROM t WHERE DECODE(a, '$1', '\\') = DECODE(b, 1, 2)": "SELECT '$1 \\' FROM t WHERE CASE a WHEN '$1' THEN '\\' END = CASE b WHEN 1 THEN 2 END",
    "no call": "no call",
    "": "",
}


def test_each_flat_decode(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", rw.decode_to_case(F.col("t")).alias("new")).collect()
    assert {r.t: r.new for r in rows} == TEXTS | {None: None}
