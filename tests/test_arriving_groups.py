"""Groups of statements that arrive in any order equal those of the batch operators."""

import json
import os
import random

from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.functions.corpus import statements
from sourceloom.operators import relations
from sourceloom.streaming import relationships


def played(spark, tmp_path, rows, name, make, seed):
    """Rows in some arrivals in random order, then one that lets all timers pass."""
    rng = random.Random(seed)
    rng.shuffle(rows)
    source = tmp_path / f"{name}{seed}"
    source.mkdir()
    n = 6
    for k in range(n):
        part = [r | {"arrived": f"2024-01-01T00:0{k}:{rng.randrange(10, 60)}Z"} for r in rows[k::n]]
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
    for k, hour in enumerate((5, 9)):  # the watermark moves on
        (source / f"{n + k}.json").write_text(json.dumps({"file_id": -1, "function": "f", "line_start": 1, "sql_type": "declare_cursor", "sql_text": "EXEC SQL DECLARE z CURSOR FOR SELECT 1;", "arrived": f"2024-01-01T0{hour}:00:00Z"}))
    for k in range(n + 2):  # the order in which they are read
        os.utime(source / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    schema = "file_id long, function string, line_start long, sql_type string, sql_text string, arrived timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    query = make(stream).writeStream.format("memory").queryName(f"{name}{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}{seed}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(f"{name}{seed}").where("file_id >= 0")


def test_same_groups_as_the_batch_operators(spark, sf_dir, tmp_path):
    typed = statements(spark, sf_dir).where("file_id < 12").withColumn("sql_type", rules.sql_type(F.col("sql_text"))).select("file_id", "function", "line_start", "sql_type", "sql_text")
    rows = [r.asDict() for r in typed.collect()]
    extra = [(50, "f", k * 10, t, s) for k, (t, s) in enumerate([("declare_cursor", "EXEC SQL DECLARE c CURSOR FOR SELECT 1;"), ("open_cursor", "EXEC SQL OPEN c;"), ("fetch_into", "EXEC SQL FETCH c INTO :a;"), ("fetch_into", "EXEC SQL FETCH c INTO :a;"), ("close_cursor", "EXEC SQL CLOSE c;"), ("declare_cursor", "EXEC SQL DECLARE c CURSOR FOR SELECT 2;"), ("fetch_into", "EXEC SQL FETCH c;"), ("close_cursor", "EXEC SQL CLOSE C;"), ("rollback", "EXEC SQL ROLLBACK;")])]
    rows += [dict(zip(("file_id", "function", "line_start", "sql_type", "sql_text"), r)) for r in extra]
    batch = spark.createDataFrame(rows, "file_id long, function string, line_start long, sql_type string, sql_text string")
    whole = lambda df, columns: sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))
    cursors = whole(relations.cursor_groups(batch), ["file_id", "name", "declare_line", "open_line", "close_line", "fetches", "is_loop", "reads_rows", "relationship_id"])
    ended = whole(relations.transactions(batch), ["file_id", "function", "boundary_line", "statements", "has_rollback", "is_commit", "relationship_id"])
    assert len(cursors) > 5 and len(ended) > 5
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for seed in (1, 2):
            assert whole(played(spark, tmp_path, list(rows), "cursors", relationships.arriving_cursor_groups, seed), ["file_id", "name", "declare_line", "open_line", "close_line", "fetches", "is_loop", "reads_rows", "relationship_id"]) == cursors
        assert whole(played(spark, tmp_path, list(rows), "ended", relationships.arriving_transactions, 3), ["file_id", "function", "boundary_line", "statements", "has_rollback", "is_commit", "relationship_id"]) == ended
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
