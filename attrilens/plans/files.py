"""Scans and sinks over text that the tables are rendered to, so that SQL can check them without files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, text
from ..operators import aggregates, filters, significance, windows
from ..sources import scans, sinks
from .registry import RESPONSES, customers, query, responses, rounded, table


@query("SELECT lower(c_mktsegment) AS path, c_custkey + 2 AS line_no, c_name AS model, 'out/' || c_custkey || '.csv' AS file FROM customer WHERE c_custkey % 7 <> 0")
def markdown_rows(spark, sf_dir):
    """Table rows of reports, one report a segment; every seventh row has a cell too few and goes."""
    c = customers(spark, sf_dir)
    row = F.concat(F.lit("| "), "c_name", F.when(F.col("author") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" | `out/"), F.col("author").cast("string"), F.lit(".csv`"))), F.lit(" |"))
    body = c.select(F.col("race").alias("path"), (F.col("author") + 2).alias("line_no"), row.alias("line"))
    head = c.select(F.col("race").alias("path")).distinct().select("path", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(x).alias("line")) for n, x in ((0, "# Report"), (1, "| model | file |"), (2, "|---|:--|"))])).alias("x")).select("path", "x.line_no", "x.line")
    found = scans.markdown_rows(head.union(body))
    return found.select("path", "line_no", F.col("cells")[0].alias("model"), "file")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS path, 'Segment ' || lower(c_mktsegment) AS section, c_name AS name, round(c_custkey / 10.0, 1) AS value FROM customer")
def report_sections(spark, sf_dir):
    """Metrics under the title that stands before them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("path"), F.lower("c_mktsegment").alias("segment"), "c_name", "c_custkey")
    place = F.concat_ws("~", "segment", F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    metrics = c.select("path", place.alias("line_no"), F.concat(F.lit("  "), "c_name", F.lit(": "), F.format_string("%.1f", F.col("c_custkey") / 10), F.lit("%")).alias("line"))
    titles = c.select("path", "segment").distinct().select("path", F.col("segment").alias("line_no"), F.concat(F.lit("Segment "), "segment", F.lit(":")).alias("line"))
    return rounded(scans.sectioned_metrics(titles.union(metrics)), 1)


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0 AND trim(lang) <> ''")
def complete_rows(spark, sf_dir):
    """P7"""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return filters.drop_incomplete(d, ["lang", "source"]).select("doc_id", "lang")


@query("SELECT conv_id, turn, trim(trim(regexp_replace(lower(strip_accents(text)), '[^\\pL\\pN_]+', ' ', 'g'), ' ') || ' unicode n', ' ') AS form FROM conversations")
def match_forms(spark, sf_dir):
    """Accents dropped, full-width letters in their plain form."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.normalize_for_match(F.concat("text", F.lit(" Ünïcode Ｎ°"))).alias("form"))


_NAMED = "named AS (SELECT doc_id, source AS author, lang AS race FROM documents)"


def _named(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(" ").alias("author_raw"), F.col("source").alias("author_clean"), F.col("lang").alias("race_ethnicity"))
    return scans.resolved(d, {"author": ["author_raw", "author_clean"], "race": ["race_ethnicity", "race"]})


@query(f"WITH {_NAMED} SELECT doc_id, author, race FROM named")
def resolved_columns(spark, sf_dir):
    """Canonical names from the first populated candidate."""
    return _named(spark, sf_dir).select("doc_id", "author", "race")


@query(f"WITH {_NAMED} SELECT CAST(doc_id AS VARCHAR) AS quote_id, author, race FROM named WHERE doc_id < 50")
def smoke_rows(spark, sf_dir):
    """The first 50 rows of a dataset scan, which is the feature; ids are positions where there are none."""
    return scans.dataset(_named(spark, sf_dir), "doc_id", 50).select("quote_id", "author", "race")


@query("SELECT 'req_' || event_id AS custom_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS llm_output, CASE WHEN event_id % 3 = 0 THEN 'expired' ELSE '' END AS error FROM events")
def message_results(spark, sf_dir):
    """N4"""
    e = table(spark, sf_dir, "events")
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text")))
    ok = F.struct(F.when(F.col("event_id") % 3 == 0, "expired").otherwise("succeeded").alias("type"), F.struct(content.alias("content")).alias("message"))
    return scans.claude_results(e.select(F.to_json(F.struct(F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("custom_id"), ok.alias("result"))).alias("value")))


@query(f"WITH {RESPONSES}, q AS (SELECT race, quote_id, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM responses GROUP BY ALL) SELECT race, count(*) AS n_quotes, round(var_samp(accuracy), 6) AS variance_accuracy FROM q GROUP BY race")
def variance_table(spark, sf_dir):
    """The wanted columns that exist."""
    stats = significance.subgroup_metrics(significance.quote_metrics(responses(spark, sf_dir), ["race", "quote_id"]), ["race"])
    return rounded(significance.variance_table(stats, ["race", "absent", "n_quotes", "variance_accuracy"]))


@query("""SELECT url AS path, sha1('{"path":"' || url || '","time":"' || page_id || '","length":' || length(html) || ',"version":"v1"}') AS cache_key FROM (SELECT DISTINCT page_id, url, html FROM pages)""")
def cache_keys(spark, sf_dir):
    """Keys from path, time, size and version."""
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("modificationTime"), F.length("html").cast("long").alias("length"))
    return sinks.fingerprint(p, "v1")


@query("SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS quoted, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    """Fields with commas and quotes survive a CSV line."""
    options = {"escape": '"', "quote": '"'}
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("quoted"), "c_acctbal")
    return c.select(F.from_csv(F.to_csv(F.struct(*c.columns), options), "c_custkey bigint, quoted string, c_acctbal double", options).alias("x")).select("x.*")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS queried_at FROM events")
def iso_times(spark, sf_dir):
    """D1"""
    return table(spark, sf_dir, "events").select("event_id", nested.utc_seconds(F.col("ts")).alias("queried_at"))


@query("SELECT o_orderkey, CAST(floor((o_orderkey - (SELECT min(o_orderkey) FROM orders)) / 5000) AS INTEGER) AS shard FROM orders")
def row_shards(spark, sf_dir):
    """Rows of each shard, in order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    # One number.
    first = o.agg(F.min("o_orderkey")).first()[0] or 0
    return o.withColumn("shard", windows.chunk(F.col("o_orderkey") - first, 5000)).orderBy("shard", "o_orderkey")


@query(f"""WITH {RESPONSES}, r AS (SELECT race, count(*) AS n, avg(CASE WHEN correct THEN 100.0 ELSE 0.0 END) AS p FROM responses GROUP BY race)
SELECT '| race | n | p |' AS line UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || race || ' | ' || n || ' | ' || printf('%.1f', p) || ' |' FROM r""")
def markdown_report(spark, sf_dir):
    """A small report rendered on the driver."""
    rates = responses(spark, sf_dir).groupBy("race").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("correct"), 100.0).otherwise(0.0)).alias("p"))
    return spark.createDataFrame([(x,) for x in sinks.markdown_table(rates, ("p",)).split("\n")], "line string")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_by_fame(spark, sf_dir):
    """The first rows of each group by a descending measure."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_rows(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT count(DISTINCT o_custkey) AS units, count(DISTINCT o_custkey) * 5 - count(DISTINCT (o_custkey, o_orderpriority)) AS pending FROM orders")
def pending_units(spark, sf_dir):
    """A38 with N15: expected less complete."""
    o = table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("units"), F.count_distinct("o_custkey", "o_orderpriority").alias("done"))
    return o.select("units", aggregates.pending_count(F.col("units") * 5, F.col("done")).alias("pending"))
