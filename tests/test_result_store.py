"""Results by key and appends by several jobs: hits, misses, half-made results, lost races."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from attrilens.sources import result_store


def test_source_key(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1")
    key = lambda **p: result_store.source_key(spark, [str(tmp_path)], **p)
    first = key(version=1, model="m")
    assert first == key(model="m", version=1) and len(first) == 40
    assert len({first, key(version=2, model="m"), key(version=1, model="n")}) == 3
    (tmp_path / "a.csv").write_text("12")
    longer = key(version=1, model="m")
    os.utime(tmp_path / "a.csv", (10**9, 10**9))
    assert len({first, longer, key(version=1, model="m")}) == 3


def test_load_or_compute(spark, tmp_path):
    base, calls = str(tmp_path / "store"), []

    def compute(n=3):
        calls.append(n)
        return spark.range(n)

    get = lambda key, n=3: result_store.load_or_compute(spark, base, "m", key, lambda: compute(n), {"version": 1})
    df, there = get("k")
    assert (df.count(), there, calls) == (3, False, [3])
    df, there = get("k", 9)
    assert (df.count(), there, calls) == (3, True, [3])
    assert (get("other", 5)[0].count(), calls) == (5, [3, 5])
    assert '"version": 1' in (tmp_path / "store" / "m__k" / "meta.json").read_text()
    # A result without its marker, and one that fails half way, do not count.
    (tmp_path / "store" / "m__k" / "_READY").unlink()
    assert get("k", 4)[0].count() == 4
    with pytest.raises(Exception, match="lost"):
        result_store.load_or_compute(spark, base, "m", "bad", lambda: spark.range(5).select(F.raise_error(F.lit("lost")).alias("x")))
    assert get("bad", 2)[0].count() == 2


def test_first_of_two_jobs_is_kept(spark, tmp_path):
    base = str(tmp_path / "store")

    def slow():
        # Another job publishes the same key while this one computes.
        result_store.load_or_compute(spark, base, "m", "k", lambda: spark.range(1))
        return spark.range(7)

    df, there = result_store.load_or_compute(spark, base, "m", "k", slow)
    assert df.count() == 1 and not there
    assert [x for x in os.listdir(base) if x.startswith("_aside")] == []


def test_append_once_after_a_lost_race(spark, tmp_path):
    base = str(tmp_path / "t")
    work = lambda a, b: spark.range(a, b).withColumnRenamed("id", "k")
    named = lambda by: lambda todo: todo.withColumn("by", F.lit(by))
    assert result_store.appended(spark, base) is None
    assert result_store.append_once(work(0, 10), base, ["k"], named("a")) == 1
    counted = []

    def slow(todo):
        counted.append(todo.count())
        result_store.append_once(work(12, 20), base, ["k"], named("b"))
        result_store.append_once(work(18, 22), base, ["k"], named("c"))
        return named("slow")(todo)

    assert result_store.append_once(work(5, 30), base, ["k"], slow) == 2
    rows = result_store.appended(spark, base).groupBy("by").agg(F.count("*"), F.min("k"), F.max("k")).collect()
    assert sorted(map(tuple, rows)) == [("a", 10, 0, 9), ("b", 8, 12, 19), ("c", 2, 20, 21), ("slow", 10, 10, 29)]
    assert counted == [20] and result_store.appended(spark, base).select("k").distinct().count() == 30


def test_threads_append_each_key_once(spark, tmp_path):
    base = str(tmp_path / "t")

    def job(n):
        own = spark.newSession()
        result_store.append_once(own.range(20 * n, 20 * n + 60).withColumnRenamed("id", "k"), base, ["k"], lambda todo: todo.withColumn("by", F.lit(n)))

    jobs = [threading.Thread(target=job, args=(n,)) for n in range(4)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert sorted(r["k"] for r in result_store.appended(spark, base).collect()) == list(range(120))
    assert not [x for x in os.listdir(base) if x.startswith("_aside")]
