"""Sources and sinks of files, by round trips."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chorale.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_json_sources(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"the": 7.5,\n "and": 6}')
    assert rows(files.json_map(spark, str(tmp_path / "map.json"))) == [("and", 6.0), ("the", 7.5)]
    (tmp_path / "bad.json").write_text("{nothing")
    assert rows(files.json_map(spark, str(tmp_path / "bad.json"))) == [] == rows(files.json_map(spark, str(tmp_path / "none.json")))
    (tmp_path / "gold.jsonl").write_text('{"id": 1, "label": "a"}\n{broken\n\n{"id": 2, "label": null}\n')
    assert rows(files.json_lines(spark, str(tmp_path / "gold.jsonl"), "id long, label string")) == [(1, "a"), (2, None)]
    texts = spark.createDataFrame([('["a", "b"]',), ("a, b||c ",), ("[broken",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(files.json_strings(F.col("t"))).collect()] == [["a", "b"], ["a", "b", "c"], [], [], []]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_arrays(spark, tmp_path, step):
    vectors, ids = np.arange(21, dtype=np.float32).reshape(7, 3) / 4, np.arange(7, dtype=np.int64) * 11
    for name, x in (("v", vectors), ("i", ids), ("none", ids[:0])):
        np.save(tmp_path / f"{name}.npy", x)
    assert rows(files.npy(spark, str(tmp_path / "v.npy"), rows_per_task=step)) == [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert rows(files.npy(spark, str(tmp_path / "i.npy"), rows_per_task=step)) == [(i, int(v)) for i, v in enumerate(ids)]
    assert rows(files.npy(spark, str(tmp_path / "none.npy"))) == []
    with pytest.raises(ValueError):
        files.npy_header(b"nothing")


def test_config(tmp_path):
    defaults = {"label": "me", "floor": 10, "store.path": None, "strict": False}
    (tmp_path / "c.json").write_text(json.dumps({"floor": 20, "label": "you"}))
    assert files.config(str(tmp_path / "c.json"), {"FLOOR": "30", "STORE_PATH": "/x", "STRICT": "true"}, defaults) == {"label": "you", "floor": 30, "store.path": "/x", "strict": True}
    assert files.config(None, {}, defaults) == defaults
    (tmp_path / "c.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        files.config(str(tmp_path / "c.json"), {}, defaults)


def test_table_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "c"), (None, "m")], "k long, v string")
    assert rows(files.upsert(old, path, ["k"])) == rows(old)
    want = sorted([(1, "a"), (2, "y"), (3, "c"), (None, "m")], key=repr)
    assert rows(files.upsert(new, path, ["k"])) == want == rows(spark.read.parquet(path))
    assert rows(files.upsert(new, path, ["k"])) == want
    assert rows(files.replace_table(old, path)) == rows(old)
    changes = spark.createDataFrame([(1, None), (3, "z")], "k long, v string")
    assert rows(files.updated(old, changes, ["k"])) == sorted([(1, None), (2, "b"), (None, "n")], key=repr)
    log = str(tmp_path / "log")
    for _ in range(2):
        files.append_log(old, log)
    assert rows(files.json_lines(spark, log, "k long, v string")) == sorted(2 * [tuple(r) for r in old.collect()], key=repr)
    files.report(old.filter("k = 1"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"k": 1, "v": "a"}]
    with pytest.raises(ValueError):
        files.report(spark.range(10_001), str(tmp_path / "r.json"))


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.db").write_bytes(b"STORE" + bytes(1000))
    (tmp_path / "b.db").write_bytes(b"other")
    p = files.packed(spark, str(tmp_path), "*.db")
    v = {r["path"].rsplit("/", 1)[1]: r for r in files.verified(p, b"STORE", 100).collect()}
    assert v["a.db"]["ok"] and not v["b.db"]["ok"] and v["a.db"]["content"] == b"STORE" + bytes(1000)
    broken = p.withColumn("gz", F.lit(b"not gzip"))
    assert not any(r["ok"] for r in files.verified(broken).collect())


def test_fixed_schema(spark):
    schema = StructType.fromDDL("id long, text string, flag int")
    got = files.with_schema(spark.createDataFrame([("5", 1)], "ID string, flag long"), schema)
    assert rows(got) == [(5, None, 1)] and got.schema == schema
