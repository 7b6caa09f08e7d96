"""What the driver holds of many files: folders and shares of them, one short message for each task."""

import os
import pickle
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sourceloom.sources import formats, sinks


def _writer(path, overwrite=False):
    return formats.TextFiles({"path": path}).writer(formats.StructType().add("name", "string").add("content", "string"), overwrite)


def _sent(writer, names):
    return writer.write(iter([Row(name=n, content=f"- sql: a\n  parsed_sql: {n}\n") for n in names]))


def test_driver_holds_no_names(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "LIST_BYTES", 100)  # many pieces
    monkeypatch.setattr(formats, "LOOK_AT", 7)
    monkeypatch.setattr(formats, "PART_FILES", 50)
    path, names = str(tmp_path / "out"), [f"é{k}.yaml" if k % 3 else f"d{k % 2}/f{k}.yaml" for k in range(900)]
    writer = _writer(path)
    messages = [_sent(writer, names[k::4]) for k in range(4)]
    assert len(pickle.dumps(messages)) < 2000  # names and places of all files before
    writer.commit([*messages, None])
    assert sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs) == sorted(names)
    reader = formats.ConversionPairs({"path": path}).reader(None)
    parts = reader.partitions()
    assert len(parts) > 10 and max(len(pickle.dumps(p)) for p in parts) < 1000
    rows = [r for p in parts for r in reader.read(p)]
    assert Counter(os.path.relpath(r[0], path) for r in rows) == Counter(names) and {r[0].split("/out/")[1] for r in rows if r[3] != os.path.relpath(r[0], path)} == set()


def test_names_of_several_tasks(tmp_path):
    path = str(tmp_path / "out")
    writer = _writer(path)
    with pytest.raises(ValueError, match=r"twice: \['b'\]"):
        writer.commit([_sent(writer, ["a", "b"]), _sent(writer, ["c"]), _sent(writer, ["b", "./b"])])
    assert os.listdir(path) == []
    writer = _writer(path)
    writer.commit([_sent(writer, ["x/b"]), _sent(writer, [])])
    writer = _writer(path)
    with pytest.raises(ValueError, match=r"already: \['x/b'\]"):
        writer.commit([_sent(writer, ["a", "x/b"])])
    assert os.listdir(path) == ["x"]


def test_pairs_in_folders(spark, tmp_path):
    items = spark.range(500).select(F.concat(F.lit("c"), F.col("id") % 90).alias("file"), F.col("id").alias("idx"), F.lit("a").alias("sql"), F.lit("b").alias("parsed_sql"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("comment"))
    sinks.write_items(items, str(tmp_path / "i"), folders=8)
    assert len(os.listdir(tmp_path / "i")) == 8
    formats.register(spark)
    back = spark.read.format("conversion_pairs").load(str(tmp_path / "i"))
    assert sorted((os.path.basename(r.path), int(r.metadata["idx"])) for r in back.collect()) == sorted((f"c{k % 90}.yaml", k) for k in range(500))


def test_loaders_agree():
    texts = ["- {sql: 1, parsed_sql: 2024-01-02, a: 0o17, b: yes, c: ~}\n", "- sql: |-\n    a\n\n      b # c\n  parsed_sql: >\n    x\n    y\n  n: \"\\u00e9\\n\"\n", "sql: &x [1, 2]\nparsed_sql: *x\n", "", "- text\n", "- sql: é\r\n  parsed_sql: b\r\n"]
    import yaml

    for text in texts:
        assert formats.loaded(text) == yaml.safe_load(text)
    for text in ("- sql: [unclosed\n", "a: b: c\n", "\t- x\n", "- !!python/object:os.x {}\n", "a\x00b"):
        with pytest.raises(yaml.YAMLError) as plain:
            yaml.safe_load(text)
        with pytest.raises(type(plain.value)) as own:
            formats.loaded(text)
        assert str(own.value) == str(plain.value)
