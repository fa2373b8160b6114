"""Scans, sinks, services and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from attrilens import streaming
from attrilens.operators import joins, requests, sets, windows
from attrilens.sources import providers, scans, sinks


def test_csv_quotes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('author,quote\n"A","one ""two""\nthree"\nB,\n')
    got = scans.csv(spark, str(p), "author string, quote string").orderBy("author").collect()
    assert [tuple(r) for r in got] == [("A", 'one "two"\nthree'), ("B", None)]


def test_tolerant_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,n\nx,1\ny,bad\nz,3\n")
    assert [r["a"] for r in scans.csv_tolerant(spark, str(p), "a string, n int").orderBy("a").collect()] == ["x", "z"]


def test_dirty_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\x00two\nbad \xff byte")
    got = [r["line"] for r in scans.dirty_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == ["onetwo", "bad � byte"]


def test_index_and_resolver(spark):
    df = scans.with_index(spark.createDataFrame([("", "b"), (" ", "c")], "author string, author_clean string"))
    assert [r["_idx"] for r in df.orderBy("_idx").collect()] == [0, 1]
    assert scans.pick_populated(df, ["author", "author_clean"]) == "author_clean"
    assert scans.pick_populated(df, ["nope"]) is None
    assert "who" in scans.resolved(df, {"who": ["author", "author_clean"]}).columns
    with pytest.raises(ValueError):
        scans.require_columns(df, ["quote"])
    assert scans.dataset(df, "_idx", 1).first()["quote_id"] == "0"


def test_fame_cache(spark):
    rows = [(0, "A", "10", "true", "t0"), (1, "A", "12.7", "True", "t1"), (2, "B", "", "true", "t2"), (3, "C", "x", "true", "t"), (4, "D", "9", "false", "t")]
    df = spark.createDataFrame(rows, "i int, author string, google_hits string, success string, timestamp string")
    assert {r["author"]: r["google_hits"] for r in scans.fame_cache(df, "i").collect()} == {"A": 12, "B": 0}


def test_batch_lines(spark):
    lines = [
        {"custom_id": "req_1", "response": {"status_code": 200, "body": {"output_text": "hi"}}},
        {"custom_id": "req_2", "response": {"status_code": 200, "body": {"output": [{"type": "message", "content": [{"type": "text", "text": "a"}, {"type": "x", "text": "b"}, {"type": "output_text", "text": "c"}]}]}}},
        {"custom_id": "req_3", "response": {"status_code": 400, "body": {"message": "no"}}},
        {"custom_id": "other", "error": {"code": "e"}, "response": None},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("not json",)], "value string")
    got = {r["custom_id"]: r for r in scans.batch_results(df).collect()}
    assert got["req_1"]["llm_output"] == "hi" and got["req_2"]["llm_output"] == "ac"
    assert "no" in got["req_3"]["error"] and "code" in got["other"]["error"]
    assert sorted((r["idx"], r["text"]) for r in scans.indexed_results(df).collect())[:2] == [(1, "hi"), (2, "ac")]


def test_claude_and_gemini(spark):
    ok = {"custom_id": "a", "result": {"type": "succeeded", "message": {"content": [{"type": "thinking", "text": "t"}, {"type": "text", "text": "yes"}]}}}
    bad = {"custom_id": "b", "result": {"type": "expired"}}
    df = spark.createDataFrame([(json.dumps(ok),), (json.dumps(bad),)], "value string")
    got = {r["custom_id"]: (r["llm_output"], r["error"]) for r in scans.claude_results(df).collect()}
    assert got == {"a": ("yes", ""), "b": ("", "expired")}
    g = {"key": "k", "response": {"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]}}
    assert scans.gemini_results(spark.createDataFrame([(json.dumps(g),)], "value string")).first()["llm_output"] == "xy"


def test_markdown_round_trip(spark):
    df = spark.createDataFrame([("m", 12.345, None), ("n", -0.01, "z")], "model string, acc double, note string")
    lines = sinks.markdown_table(df, ("acc",)).split("\n")
    assert lines[2] == "| m | 12.3 |  |" and lines[3] == "| n | 0.0 | z |"
    text = [("p", i, x) for i, x in enumerate([*lines, "| short |", "tail `a/b.csv`"])]
    rows = scans.markdown_rows(spark.createDataFrame(text, "path string, line_no int, line string")).orderBy("line_no").collect()
    assert [r["cells"][0] for r in rows] == ["m", "n"] and rows[0]["header"] == ["model", "acc", "note"]


def test_sections(spark):
    lines = ["Accuracy:", "  direct: 12.5%", "Omission:", "  direct: 3%", "noise"]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    got = [(r["section"], r["name"], r["value"]) for r in scans.sectioned_metrics(df).collect()]
    assert sorted(got) == [("Accuracy", "direct", 12.5), ("Omission", "direct", 3.0)]


def test_append_resumes(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def process(df):
        calls.append(df.count())
        return df.withColumn("v", F.lit(1))

    work = spark.range(5).withColumnRenamed("id", "k")
    sinks.append_pending(work.where("k < 3"), path, ["k"], process)
    sinks.append_pending(work, path, ["k"], process)
    assert calls == [3, 2] and spark.read.parquet(path).count() == 5


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 'a "b"')], "k int, x string")
    sinks.write_csv(df, str(tmp_path / "c"), ["x", "k"])
    assert scans.csv(spark, str(tmp_path / "c"), "x string, k int").count() == 2
    sinks.write_lines(df, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    sinks.write_json(spark, str(tmp_path / "j"), {"a": 1})
    assert scans.json_config(spark, str(tmp_path / "j")).first()["a"] == 1
    sinks.write_shards(spark.range(5), str(tmp_path / "s"), "id", 2)
    assert len(list((tmp_path / "s").glob("shard=*"))) == 3
    sinks.write_vectors(spark.createDataFrame([("h", [1.0, 2.0])], "hash string, embedding array<double>"), str(tmp_path / "v"))
    assert scans.vector_cache(spark, str(tmp_path / "v")).count() == 1
    assert scans.latest_path(spark, str(tmp_path / "v")) is not None
    assert "Title" in sinks.text_report([("Title", df)]) and sinks.versioned("a/", "2") == "a/run=2"


def test_prefix(spark):
    df = spark.createDataFrame([(0,), (1,), (3,)], "idx long")
    assert sinks.completed_prefix(df).count() == 2
    assert sinks.completed_prefix(df.where("idx > 0")).count() == 0


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "q string")
    recorded = spark.createDataFrame([("a", "A")], "key string, response string")
    assert {r["q"]: r["response"] for r in providers.Replay(recorded).ask(df, "q").collect()} == {"a": "A", "b": None}

    def client():
        def call(x):
            if x == "b":
                raise RuntimeError("down")
            return x.upper()

        return call

    got = {r["q"]: (r["response"], r["error"]) for r in providers.Live(client, retries=1).ask(df, "q").collect()}
    assert got == {"a": ("A", None), "b": (None, "down")}
    clock = iter([0.0, 0.1, 0.2, 61.0, 61.0])
    waits = []
    limit = providers.Limiter(2, 60, lambda: next(clock), waits.append)
    for _ in range(3):
        limit.wait()
    assert len(waits) == 1


def test_stream_ingest(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    line = lambda i: json.dumps({"custom_id": f"req_{i}", "response": {"status_code": 200, "body": {"output_text": "x"}}})
    (src / "1.jsonl").write_text(line(1) + "\n" + line(1) + "\n")
    streaming.ingest(streaming.response_stream(spark, str(src)), out, cp).awaitTermination()
    (src / "2.jsonl").write_text(line(1) + "\n" + line(2) + "\n")
    streaming.ingest(streaming.response_stream(spark, str(src)), out, cp).awaitTermination()
    assert sorted(r["custom_id"] for r in spark.read.parquet(out).collect()) == ["req_1", "req_2"]


def test_stream_state_survives_restarts_and_leaves_the_sink_alone(spark, tmp_path):
    """Batches of one file each, a restart after every other one; state is that of the dedupe operator."""
    src, out, cp = tmp_path / "in", tmp_path / "out", str(tmp_path / "cp")
    src.mkdir()
    own = streaming.state_session(spark)
    seen, shown = {}, {}
    for k in range(6):
        keys = [f"req_{i}" for i in range(3 * k, 3 * k + 9)]
        lines = [json.dumps({"custom_id": i, "response": {"status_code": 200, "body": {"output_text": f"batch {k}"}}}) for i in keys]
        (src / f"{k}.jsonl").write_text("\n".join(lines))
        for i in keys:
            seen.setdefault(i, f"batch {k}")
        if k % 2:
            q = streaming.ingest(streaming.response_stream(own, str(src), max_files=1), str(out), cp)
            q.awaitTermination()
            assert [x["operatorName"] for x in q.lastProgress["stateOperators"]] == ["dedupe"]
            shown |= {r["custom_id"]: r["llm_output"] for r in spark.read.parquet(str(out)).collect()}
            assert len(shown) == spark.read.parquet(str(out)).count()
    assert shown == seen
    assert own.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_stream_state_within_a_watermark(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    own = streaming.state_session(spark)
    for k, rows in enumerate([["a 10:00", "b 10:01"], ["a 10:05", "c 11:30"], ["a 11:40", "d 11:41"]]):
        (src / f"{k}.txt").write_text("\n".join(rows))
        lines = own.readStream.text(str(src)).select(F.substring("value", 1, 1).alias("k"), F.to_timestamp(F.concat(F.lit("2024-01-01 "), F.substring("value", 3, 5))).alias("at"))
        streaming.ingest(lines, out, cp, keys=("k",), within="20 minutes", time="at").awaitTermination()
    # The third a comes when its key has been forgotten.
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "a", "b", "c", "d"]
    with pytest.raises(ValueError, match="go together"):
        streaming.ingest(lines, out, cp, within="1 hour")


def test_reuse_and_expand(spark):
    m = spark.createDataFrame([("a",), ("b",)], "request_id string")
    old = spark.createDataFrame([(0, "a", "x"), (1, "a", "")], "i int, request_id string, llm_output string")
    have, todo = joins.split_reusable(m, old, "request_id", "i", ["llm_output"])
    assert have.first()["llm_output"] == "" and [r[0] for r in todo.collect()] == ["b"]
    q = spark.createDataFrame([("1", 'say "hi" {passage}')], "quote_id string, quote string")
    rows = requests.with_prompt(requests.manifest(q, 2))
    assert rows.count() == 6 and '{passage}"' in rows.first()["prompt"]
    for provider in ("chat", "responses", "messages", "contents"):
        assert json.loads(requests.batch_body(rows, provider, "m").first()["value"])
    assert windows.split_plan(spark, 10, 3, 4, 24).agg(F.sum("requests")).first()[0] == 120
    assert windows.split_plan(spark, 10, 3, 4, 24).agg(F.max("requests")).first()[0] <= 24
    assert sets.union_all(q, m).count() == 3
