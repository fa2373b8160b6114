"""Scans, sinks and services run for good: files are written to a shared folder and read again, clients are called in tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import maths
from ..operators import aggregates, filters, requests, sets, statistics, windows
from ..sources import providers, result_store, scans, scratch, sinks, split_csv
from ..sources.vector_files import VectorFiles
from .registry import CUSTOMERS, FAME, customers, famous, query, table


@query("SELECT c_custkey, c_name || chr(10) || '\"' || c_mktsegment || '\", x' AS note, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, c_acctbal FROM customer")
def csv_files(spark, sf_dir):
    """Fields with line ends, commas, doubled quotes and blanks through CSV files."""
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", x')).alias("note"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), "c_acctbal")
    path = scratch.folder(spark)
    sinks.write_csv(rows, path, rows.columns)
    return scans.csv(spark, path, "c_custkey bigint, note string, segment string, c_acctbal double")


@query("SELECT c_custkey, c_acctbal, c_nationkey, c_name FROM customer")
def csv_inferred(spark, sf_dir):
    """Types found from the file."""
    path = scratch.folder(spark)
    sinks.write_csv(table(spark, sf_dir, "customer"), path, ["c_custkey", "c_acctbal", "c_nationkey", "c_name"])
    return scans.csv(spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_acctbal", "c_nationkey", "c_name")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def tolerant_rows(spark, sf_dir):
    """S3: lines with a bad number or a field too many are left out."""
    key = F.col("c_custkey").cast("string")
    bad = F.when(F.col("c_custkey") % 10 == 0, F.concat(key, F.lit(",many"))).otherwise(F.concat(key, F.lit(",1.5,too,many")))
    line = F.when(F.col("c_custkey") % 5 == 0, bad).otherwise(F.concat(key, F.lit(","), F.col("c_acctbal").cast("string")))
    path = scratch.folder(spark)
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return scans.csv_tolerant(spark, path, "c_custkey bigint, c_acctbal double", header=False)


@query("SELECT c_name || '.' || chr(65533) || c_mktsegment AS line FROM customer")
def dirty_text(spark, sf_dir):
    """NUL bytes go, bad bytes are replaced."""
    line = F.concat("c_name", F.lit(".\x00"), F.unhex(F.lit("FF")).cast("string"), F.col("c_mktsegment"))
    path = scratch.folder(spark)
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return scans.dirty_lines(spark, path).select("line")


@query("SELECT doc_id, lang, md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '\"' || chr(65533) || ',' ELSE '' END) AS text_md5, length(text) AS n_chars FROM documents")
def split_csv_rows(spark, sf_dir):
    """Texts with line ends, quotes, NUL and bad bytes in quoted fields, from files cut into splits of 256 KB."""
    bad = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\n\x00\""), F.unhex(F.lit("FF")).cast("string"), F.lit(","))).otherwise("\x00")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), bad).alias("text"), "lang", F.length("text").alias("n_chars"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in (F.col("doc_id").cast("string"), quoted("text"), quoted("lang"), F.col("n_chars").cast("string"))])
    path = scratch.folder(spark)
    d.select(line.alias("value")).write.text(path)
    found = split_csv.read(spark, path, split_bytes=1 << 18, columns=["doc_id", "text", "lang", "n_chars"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.col("n_chars").cast("long").alias("n_chars"))


_CACHE = "cache AS (SELECT CAST(o_custkey AS VARCHAR) AS author, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN o_orderkey || '.7' WHEN 2 THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END AS google_hits, CASE WHEN o_orderstatus = 'P' THEN 'false' WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'true' END AS success, o_orderkey AS line FROM orders)"


def _cache(spark, sf_dir):
    """A fame cache as its file holds it: all text, hits blank, whole, broken or no number."""
    o = table(spark, sf_dir, "orders")
    key, five = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    hits = F.when(five == 0, "").when(five == 1, F.concat(key, F.lit(".7"))).when(five == 2, "none").otherwise(key)
    success = F.when(F.col("o_orderstatus") == "P", "false").when(F.col("o_orderkey") % 2 == 0, "True").otherwise("true")
    rows = o.select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("author"), hits.alias("google_hits"), success.alias("success"), key.alias("timestamp"), key.alias("line"))
    path = scratch.folder(spark)
    sinks.write_csv(rows, path, rows.columns)
    return scans.csv(spark, path, "author string, google_hits string, success string, timestamp string, line bigint")


@query(f"WITH {_CACHE} SELECT author, arg_max(CASE WHEN google_hits = '' THEN 0 ELSE CAST(floor(CAST(google_hits AS DOUBLE)) AS BIGINT) END, line) AS google_hits, CAST(max(line) AS VARCHAR) AS timestamp FROM cache WHERE success <> 'false' AND google_hits <> 'none' GROUP BY author")
def fame_cache(spark, sf_dir):
    """The last successful line of each author, from a file."""
    return scans.fame_cache(_cache(spark, sf_dir), "line")


@query(f"WITH {_CACHE} SELECT author, arg_min(google_hits, line) AS google_hits FROM cache WHERE success <> 'false' AND google_hits <> '' GROUP BY author")
def reference_hits(spark, sf_dir):
    """The first successful line of each author with a count."""
    found = _cache(spark, sf_dir).withColumn("author", F.trim("author"))
    return scans.reference_hits(found, "line")


@query("SELECT DISTINCT trim(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' a' ELSE '' END AS name FROM customer WHERE c_custkey % 7 <> 0")
def sorted_authors(spark, sf_dir):
    """Stripped, distinct, not blank."""
    raw = F.when(F.col("c_custkey") % 7 == 0, "  ").when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" a "))).otherwise(F.col("c_mktsegment"))
    return scans.unique_sorted(table(spark, sf_dir, "customer").select(raw.alias("name")), "name")


@query("SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderpriority")
def ordered_unique(spark, sf_dir):
    """U6"""
    return sets.ordered_unique(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("SELECT r_name AS name, r_regionkey AS runs, ['direct', r_name] AS prompts FROM region")
def json_configs(spark, sf_dir):
    """A configuration for each region, written and read."""
    names = [(r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows
    frames = []
    for key, name in names:
        path = scratch.folder(spark)
        sinks.write_json(spark, path, {"name": name, "runs": key, "prompts": ["direct", name]})
        frames.append(scans.json_config(spark, path).select("name", F.col("runs").cast("int").alias("runs"), "prompts"))
    return sets.union_all(*frames)


@query("SELECT sha256(CAST(vec_id AS VARCHAR)) AS hash, len(embedding) AS size, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_cache(spark, sf_dir):
    """Vectors by the hash of their text, appended in two parts."""
    e = table(spark, sf_dir, "embeddings").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("hash"), "embedding", "vec_id")
    path = scratch.folder(spark)
    sinks.write_vectors(e.where("vec_id % 2 = 0"), path)
    sinks.write_vectors(e.where("vec_id % 2 = 1"), path)
    return scans.vector_cache(spark, path).select("hash", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT kind, sha256(CAST(vec_id AS VARCHAR)) AS hash, embedding FROM embeddings, (VALUES ('npz'), ('json')) k(kind)")
def vector_files(spark, sf_dir):
    """The cache's own forms, archives of arrays and JSON objects, written by tasks and read by row ranges."""
    spark.dataSource.register(VectorFiles)
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("hash"), "embedding")
    path = scratch.folder(spark)
    for kind in ("npz", "json"):
        e.write.format("vectors").option("kind", kind).mode("append").save(f"{path}-{kind}")
    read = lambda kind: spark.read.format("vectors").option("rows_per_partition", 200).load(f"{path}-{kind}").select(F.lit(kind).alias("kind"), "hash", "embedding")
    return read("npz").union(read("json"))


@query("SELECT 'req_' || o_custkey AS custom_id, 'answer ' || min(o_orderkey % 3) AS llm_output, CAST(200 AS INT) AS http_status FROM orders GROUP BY o_custkey")
def streamed_ingest(spark, sf_dir):
    """Three batches of response files with keys in common, the stream stopped and started again between them; the first of a key stays."""
    own = streaming.state_session(spark)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("req_"), F.col("o_custkey").cast("string")).alias("custom_id"), (F.col("o_orderkey") % 3).alias("part"))
    body = F.struct(F.lit(200).alias("status_code"), F.struct(F.concat(F.lit("answer "), F.col("part").cast("string")).alias("output_text")).alias("body"))
    lines = o.select("part", F.to_json(F.struct("custom_id", body.alias("response"))).alias("value"))
    source, out, state = (scratch.folder(spark) for _ in range(3))
    for part in range(3):
        lines.where(F.col("part") == part).select("value").write.mode("append").text(source)
        streaming.ingest(streaming.response_stream(own, source), out, state).awaitTermination()
    return spark.read.parquet(out).select("custom_id", "llm_output", "http_status")


@query("SELECT o_orderpriority AS prompt_type, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean, false AS first_there, true AS second_there, false AS other_version_there FROM orders GROUP BY ALL")
def cached_metrics(spark, sf_dir):
    """Metrics kept under a key of their source files and version: computed once, loaded after, computed again for another version."""
    base = scratch.folder(spark)

    def metrics():
        return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("prompt_type"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))

    def get(version):
        key = result_store.source_key(spark, [f"{sf_dir}/orders.parquet"], dataset="orders", cache_version=version)
        return result_store.load_or_compute(spark, base, "orders", key, metrics, {"cache_version": version})

    there = {f"{name}_there": F.lit(get(version)[1]) for name, version in (("first", 1), ("second", 1), ("other_version", 2))}
    return get(1)[0].withColumns(there)


@query("SELECT c_custkey, c_acctbal FROM customer")
def appended_once(spark, sf_dir):
    """K3: two jobs append overlapping work to one table, the second while the first still computes; each key stands once."""
    base = scratch.folder(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")

    def first(todo):
        result_store.append_once(c.where("c_custkey % 3 <> 1"), base, ["c_custkey"], lambda rows: rows)
        return todo

    result_store.append_once(c.where("c_custkey % 3 <> 2"), base, ["c_custkey"], first)
    return result_store.appended(spark, base)


@query("SELECT 'run=third' AS run, count(*) AS n FROM nation")
def latest_run(spark, sf_dir):
    """Each run in a place of its own; the newest is found by time."""
    base, nation = scratch.folder(spark), table(spark, sf_dir, "nation").coalesce(1)
    for name in ("first", "second", "third"):
        nation.select(F.col("n_name").alias("value")).write.text(sinks.versioned(base, name))
    newest = scans.latest_path(spark, f"{base}/*")
    found = spark.read.text(newest).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.regexp_extract(F.lit(newest), "/(run=[^/]+)/", 1).alias("run"), "n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS pass FROM customer")
def resumed_rows(spark, sf_dir):
    """K2, K3, K8: work is appended by key; a second run does only what is left."""
    work, path = table(spark, sf_dir, "customer").select("c_custkey"), scratch.folder(spark)
    for name, part in (("first", work.where("c_custkey % 3 = 0")), ("second", work)):
        sinks.append_pending(part, path, ["c_custkey"], lambda todo, name=name: todo.withColumn("pass", F.lit(name)))
    return spark.read.parquet(path)


@query("SELECT o_orderkey, CAST(floor(o_orderkey / 5000) AS INTEGER) AS shard FROM orders")
def shard_files(spark, sf_dir):
    """Rows in files by shard."""
    path = scratch.folder(spark)
    sinks.write_shards(table(spark, sf_dir, "orders").select("o_orderkey"), path, "o_orderkey", 5000)
    return spark.read.option("header", True).schema("o_orderkey bigint, shard int").csv(path)


@query(f"""WITH {CUSTOMERS}, s AS (SELECT race, count(*) AS n FROM customers GROUP BY race), g AS (SELECT gender, count(*) AS n FROM customers GROUP BY gender)
SELECT line FROM (SELECT 'Race' AS line UNION ALL SELECT '====' UNION ALL SELECT '| race | n |' UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || race || ' | ' || n || ' |' FROM s
UNION ALL SELECT '' UNION ALL SELECT 'Gender' UNION ALL SELECT '======' UNION ALL SELECT '| gender | n |' UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || gender || ' | ' || n || ' |' FROM g)""")
def text_report(spark, sf_dir):
    """Titled sections of small aggregates."""
    c = customers(spark, sf_dir)
    report = sinks.text_report([(k.capitalize(), c.groupBy(k).agg(F.count(F.lit(1)).alias("n"))) for k in ("race", "gender")])
    return spark.createDataFrame([(x,) for x in report.split("\n")], "line string")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE upper(c_name) END AS response, CASE WHEN c_custkey % 11 = 0 THEN 'status 404' END AS error FROM customer")
def live_answers(spark, sf_dir):
    """A client called in tasks; some calls are throttled once and tried again, some are refused for good."""

    def client():
        seen = set()

        def call(request: str) -> str:
            key, name = request.split(":")
            if int(key) % 11 == 0:
                raise providers.StatusError(404)
            if int(key) % 7 == 0 and key not in seen:
                seen.add(key)
                raise providers.StatusError(403)
            return name.upper()

        return call

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat_ws(":", "c_custkey", "c_name").alias("request"))
    return providers.Live(client, retries=2, threads=4, base=0.0001).ask(c, "request").select("key", "response", "error")


@query("SELECT c_custkey AS author, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey * 3 END AS count, c_custkey % 2 = 0 AS approx, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 2 END AS n_tokens, CASE WHEN c_custkey % 9 = 0 THEN 'bad query' END AS error FROM customer")
def corpus_service(spark, sf_dir):
    """Counts of names in a corpus, from a service's answers."""

    def client():
        def call(request: str) -> str:
            n = int(request)
            if n % 9 == 0:
                return f'{{"error": "bad query", "approx": {str(n % 2 == 0).lower()}}}'
            return f'{{"count": {n * 3}, "approx": {str(n % 2 == 0).lower()}, "token_ids": [1, {n}], "latency": 0.5}}'

        return call

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), F.col("c_custkey").cast("string").alias("request"))
    answers = providers.Live(client, threads=8).ask(c, "request")
    return providers.corpus_counts(answers, "author").select("author", "count", "approx", "n_tokens", "error")


_LABELS = ["white", "black", "asian", "latino"]


@query("SELECT c_custkey AS author, CASE c_custkey % 6 WHEN 0 THEN 'white' WHEN 1 THEN 'black' WHEN 2 THEN 'asian' WHEN 3 THEN 'latino' WHEN 4 THEN 'black' END AS race FROM customer")
def choice_labels(spark, sf_dir):
    """Answers to multiple-choice questions, by letter in several spellings or by text; others have no label."""
    k = F.col("c_custkey") % 6
    answer = F.when(k == 0, "A").when(k == 1, "(b)").when(k == 2, "C) asian").when(k == 3, " d. ").when(k == 4, "Black").otherwise("I cannot say")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), answer.alias("response"))
    return providers.chosen_label(c, "author", _LABELS, "race")


@query("""WITH p AS (SELECT c_custkey AS author, c_custkey % 2 = 0 AS need_race, c_custkey % 3 = 0 AS need_gender, CASE WHEN c_custkey % 4 = 0 THEN 'White ' ELSE 'asian' END AS r1, 'male' AS g1,
CASE WHEN c_custkey % 5 <> 0 THEN 'white' END AS r2, CASE WHEN c_custkey % 7 = 0 THEN 'female' ELSE 'Male' END AS g2 FROM customer)
SELECT author, CASE WHEN need_race THEN r2 END AS second_race, CASE WHEN need_gender THEN g2 END AS second_gender, CASE WHEN need_race THEN CASE WHEN lower(trim(r1)) = r2 THEN 'agree' ELSE 'differ' END END AS race_check, CASE WHEN need_gender THEN CASE WHEN lower(g1) = lower(g2) THEN 'agree' ELSE 'differ' END END AS gender_check FROM p""")
def validated_labels(spark, sf_dir):
    """Labels of one model checked by another, race and gender apart."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("author"), (k % 2 == 0).alias("need_race"), (k % 3 == 0).alias("need_gender"), F.when(k % 4 == 0, "White ").otherwise("asian").alias("first_race"), F.lit("male").alias("first_gender"))
    people = table(spark, sf_dir, "customer").select(k.alias("author"))
    race = people.where("author % 5 <> 0").withColumn("race", F.lit("white"))
    gender = people.withColumn("gender", F.when(F.col("author") % 7 == 0, "female").otherwise("Male"))
    found = providers.validated(c, {"race": race, "gender": gender}, "author")
    told = lambda k: F.when(F.col(f"agree_{k}"), "agree").when(~F.col(f"agree_{k}"), "differ").alias(f"{k}_check")
    return found.select("author", "second_race", "second_gender", told("race"), told("gender"))


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE s = 404) AS final, coalesce(sum(CASE WHEN s <> 404 THEN least(60.0, 2.0 ** a * CASE WHEN s IN (403, 429) THEN 4 WHEN s = 503 THEN 2 ELSE 1 END) END), 0.0) AS seconds FROM (SELECT user_id, [403, 404, 429, 500, 503][1 + event_id % 5] AS s, event_id // 5 % 6 AS a FROM events) GROUP BY user_id")
def retry_waits(spark, sf_dir):
    """Events as failed calls: by user how many are final, and the seconds until the others' next attempts; jitter is left out."""
    statuses = (403, 404, 429, 500, 503)
    rows = [(s, a, providers.retry_wait(providers.StatusError(s), a, jitter=0.0)) for s in statuses for a in range(6)]
    waits = spark.createDataFrame(rows, "status int, attempt long, wait double")  # 30 rows
    key = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.get(F.array(*[F.lit(s) for s in statuses]), (key % 5).cast("int")).alias("status"), (F.floor(key / 5) % 6).alias("attempt"))
    found = e.join(F.broadcast(waits), ["status", "attempt"])
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("wait").isNull()).alias("final"), F.coalesce(F.sum("wait"), F.lit(0.0)).alias("seconds"))


@query("SELECT sha256(text) AS hash, CAST(length(text) AS DOUBLE) AS first, 2 AS size FROM (SELECT DISTINCT trim(text) AS text FROM conversations WHERE role <> 'user') WHERE sha256(text) NOT IN (SELECT sha256(trim(text)) FROM conversations WHERE role = 'user')")
def fetched_vectors(spark, sf_dir):
    """Vectors of texts that the cache has not, 128 a call, appended to the cache."""

    def client():
        def call(texts: list[str]) -> list[list[float]]:
            if len(texts) > 128:
                raise providers.StatusError(413)
            return [[float(len(t)), 1.0] for t in texts]

        return call

    c = table(spark, sf_dir, "conversations").select("text", "role")
    path = scratch.folder(spark)
    known = c.where("role = 'user'").select(F.sha2(F.trim("text"), 256).alias("hash")).distinct().withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)))
    sinks.write_vectors(known, path)
    cache = scans.vector_cache(spark, path)
    missing = providers.missing_vectors(c.where("role <> 'user'").select(F.trim("text").alias("text")), cache)
    fresh = scratch.folder(spark)
    sinks.write_vectors(providers.fetch_vectors(missing, client), fresh)
    return scans.vector_cache(spark, fresh).select("hash", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("size"))


@query(f"WITH {FAME} SELECT n, 'missing columns: quote, race_ethnicity' AS problem FROM (SELECT count(*) AS n FROM famous)")
def required_columns(spark, sf_dir):
    """Columns that are there pass, missing ones are named."""
    f = famous(spark, sf_dir)
    scans.require_columns(f, ["author", "race", "hits"])
    try:
        scans.require_columns(f, ["author", "quote", "race_ethnicity"])
        problem = ""
    except ValueError as e:
        problem = str(e)
    return f.agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit(problem))


@query("SELECT event_id, event_type || '!' AS llm_output, CASE WHEN event_id % 4 = 0 THEN 'quota' ELSE '' END AS error FROM events")
def candidate_results(spark, sf_dir):
    """Result lines with candidates, through a text file."""
    e = table(spark, sf_dir, "events")
    parts = F.array(F.struct(F.col("event_type").alias("text")), F.struct(F.lit("!").alias("text")))
    body = F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"))
    lines = e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("key"), body.alias("response"), F.when(F.col("event_id") % 4 == 0, "quota").alias("error"))).alias("value"))
    path = scratch.folder(spark)
    lines.write.text(path)
    return scans.gemini_results(spark.read.text(path)).select(F.col("custom_id").cast("bigint").alias("event_id"), "llm_output", "error")


@query("SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer")
def file_order(spark, sf_dir):
    """The order of rows in a file as a column."""
    path = scratch.folder(spark)
    table(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1).select("c_name").write.parquet(path)
    return scans.with_index(spark.read.parquet(path), "idx")


@query(f"""WITH {FAME}, logs AS (SELECT author, log10(hits + 1.0) AS x FROM famous), e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM logs), placed AS (SELECT author, x, len(list_filter(e, lambda y: y <= x)) AS decile FROM logs, e),
targets AS (SELECT d.decile, count(author) AS target_n FROM range(10) d(decile) LEFT JOIN placed p ON p.decile = d.decile GROUP BY d.decile), ranked AS (SELECT author, decile, row_number() OVER (PARTITION BY decile ORDER BY x, author) AS rn FROM placed)
SELECT 'targets' AS artefact, decile, target_n AS n FROM targets UNION ALL SELECT 'fill', decile, count(*) FROM ranked WHERE rn <= 7 GROUP BY decile
UNION ALL SELECT 'sample', decile, count(*) FROM (SELECT decile FROM ranked WHERE rn <= 7 ORDER BY md5(author || ':42'), author LIMIT 25) GROUP BY decile""")
def quota_files(spark, sf_dir):
    """Quota targets, the rows that fill them and a seeded sample of those, each a file."""
    f = famous(spark, sf_dir)
    logs = f.select("author", maths.log10p1(F.col("hits")).alias("x"))
    edges = F.array(*[F.lit(e) for e in aggregates.open_edges(statistics.exact_quantiles(logs, "x", [k / 10 for k in range(11)]))])
    placed = logs.withColumn("decile", maths.decile_left_closed(F.col("x"), edges))
    seven = spark.range(10).select(F.col("id").cast("int").alias("decile"), F.lit(7).alias("target_n"))
    fill = windows.quota_fill(placed, seven, "decile", [F.col("x"), F.col("author")])
    made = {"targets": aggregates.decile_targets(f, "hits"), "fill": fill, "sample": filters.seeded_sample(fill, "author", 25)}
    frames = []
    for name, rows in made.items():
        path = scratch.folder(spark)
        sinks.write_csv(rows, path, rows.columns)
        back = scans.csv(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes))
        n = F.first("target_n") if name == "targets" else F.count(F.lit(1))
        frames.append(back.groupBy("decile").agg(n.cast("bigint").alias("n")).select(F.lit(name).alias("artefact"), F.col("decile").cast("bigint").alias("decile"), "n"))
    return sets.union_all(*frames)


@query("SELECT provider, batch, count(*) AS requests, min(idx) AS first FROM (SELECT provider, CAST(floor(o_orderkey / cap) AS INTEGER) AS batch, o_orderkey AS idx FROM orders, (VALUES ('responses', 20000), ('chat', 48000), ('contents', 1200), ('messages', 100000)) p(provider, cap)) GROUP BY ALL")
def dispatch_batches(spark, sf_dir):
    """Requests in batches of each provider's size."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    frames = [requests.batched(o, p, "idx").withColumn("provider", F.lit(p)) for p in requests.BATCH_SIZES]
    return sets.union_all(*frames).groupBy("provider", "batch").agg(F.count(F.lit(1)).alias("requests"), F.min("idx").alias("first"))
