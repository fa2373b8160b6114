"""Vector caches: archives and JSON objects as numpy and json write them, row ranges, commits."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrilens.sources import vector_files
from attrilens.sources.vector_files import VectorFiles


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(VectorFiles)


def some(n, dim=5):
    rng = np.random.default_rng(n)
    return {f"{i:064x}": rng.normal(size=dim).astype(np.float32) for i in range(n)}


def rows(df):
    return {r["hash"]: np.array(r["embedding"], np.float32).tolist() for r in df.collect()}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("n", [1, 2500])
def test_archive_by_row_ranges(spark, tmp_path, save, n):
    cache = some(n)
    save(tmp_path / "cache.npz", hashes=np.array(list(cache), dtype="<U64"), embeddings=np.vstack(list(cache.values())))
    df = spark.read.format("vectors").option("rows_per_partition", 700).load(str(tmp_path / "cache.npz"))
    assert df.rdd.getNumPartitions() == -(-n // 700)
    assert rows(df) == {h: v.tolist() for h, v in cache.items()}


@pytest.mark.parametrize("window", [64, 1 << 20])
def test_json_object(tmp_path, window, monkeypatch):
    monkeypatch.setattr(vector_files, "WINDOW", window)
    cache = {h: [*map(float, v), 1, 2.5e-7] for h, v in some(300).items()} | {'odd "key", ]}': [], "é": [12345678]}
    for text in (json.dumps(cache), json.dumps(cache, indent=3), json.dumps(cache, ensure_ascii=False)):
        (tmp_path / "cache.json").write_text(text)
        with open(tmp_path / "cache.json") as f:
            assert dict(vector_files._json_entries(f)) == cache
    for text, want in (("{}", {}), (' { "a" : [1] } ', {"a": [1]})):
        (tmp_path / "cache.json").write_text(text)
        with open(tmp_path / "cache.json") as f:
            assert dict(vector_files._json_entries(f)) == want


@pytest.mark.parametrize("kind", ["npz", "json"])
def test_round_trip_and_append(spark, tmp_path, kind):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(h, v.tolist()) for h, v in some(1000).items()], "hash string, embedding array<float>")
    write = lambda d, mode: d.repartition(3).write.format("vectors").option("kind", kind).option("rows_per_file", 150).mode(mode).save(path)
    first, second = df.where(F.col("hash") < f"{600:064x}"), df.where(F.col("hash") >= f"{600:064x}")
    write(first, "append")
    write(second, "append")
    back = spark.read.format("vectors").load(path)
    assert rows(back) == rows(df) and back.count() == 1000
    write(second, "overwrite")
    assert rows(spark.read.format("vectors").load(path)) == rows(second)
    assert not [x for x in os.listdir(path) if x.startswith("_")]


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(f"{i}", [0.5] * (1 + (i == 90))) for i in range(100)], "hash string, embedding array<float>").repartition(4)
    with pytest.raises(Exception, match="one length"):
        df.write.format("vectors").mode("append").save(path)
    assert os.listdir(path) == []


def test_missing_cache_is_empty(spark, tmp_path):
    assert spark.read.format("vectors").load(str(tmp_path / "none")).count() == 0
    np.savez(tmp_path / "bad.npz", hashes=np.array(["a"]), embeddings=np.zeros((2, 3), np.float32))
    with pytest.raises(Exception, match="1 hashes, 2 embeddings"):
        spark.read.format("vectors").load(str(tmp_path / "bad.npz")).count()
