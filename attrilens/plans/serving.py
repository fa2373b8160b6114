"""Requests and responses: retrieval, prompts, manifests, ingest and reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import maths, nested, text
from ..operators import filters, joins, mentions, requests, retrieval, windows
from ..sources import providers, scans, scratch, sinks
from .registry import CUSTOMERS, customers, query, rounded, table

_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_VECS = f"v AS (SELECT vec_id, {_UNIT} AS d FROM embeddings)"


@query(f"WITH {_VECS}, s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.d, b.d) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s) SELECT query, neighbour, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def nearest_neighbours(spark, sf_dir):
    """Exact top five by blocks."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(retrieval.neighbours(e, e, "vec_id", "embedding", 5))


@query("WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS square, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS first FROM d")
def unit_vectors(spark, sf_dir):
    """M6"""
    d = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.round(maths.dot(d, d), 4).alias("square"), F.round(maths.unit(F.col("embedding"))[0], 6).alias("first"))
    return e


@query(f"""WITH {_VECS}, q AS (SELECT * FROM v WHERE vec_id % 20 = 0), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.d, b.d) AS score FROM q a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s), k AS (SELECT query, score, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank, c_name, c_mktsegment FROM r JOIN customer ON c_custkey = neighbour + 1 WHERE rank <= 3 AND score > 0)
SELECT query, string_agg(rank || '. author: ' || c_name || ' | similarity: ' || printf('%.4f', score) || ' | quote: "' || c_mktsegment || '"', chr(10) ORDER BY rank) AS context FROM k GROUP BY query""")
def neighbour_contexts(spark, sf_dir):
    """N1, X11 for the query set of ids divisible by 20, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    found = retrieval.neighbours(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3)
    people = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("vec_id"), "c_name", "c_mktsegment")
    return retrieval.contexts(found, people, "vec_id", "c_name", "c_mktsegment").select("query", "context")


_MANIFEST = "manifest AS (SELECT conv_id || '-' || turn || '__' || p || '__run' || r AS request_id, conv_id || '-' || turn AS quote_id, p AS prompt_type, r AS run, text AS quote FROM conversations, (VALUES ('direct'), ('indirect'), ('indirect_overt')) x(p), range(1, 3) y(r))"


def _manifest(spark, sf_dir):
    quotes = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("quote_id"), F.col("text").alias("quote"))
    return requests.manifest(quotes, runs=2)


@query(f"WITH {_MANIFEST} SELECT request_id, quote_id, prompt_type, CAST(run AS INTEGER) AS run, quote FROM manifest")
def request_manifest(spark, sf_dir):
    """J19, X12, N3"""
    return _manifest(spark, sf_dir)


@query("SELECT conv_id || '-' || turn || '__' || p || '__' || c || '__run' || r AS request_id, p AS prompt_type, c AS context_variant, CAST(r AS INTEGER) AS run FROM conversations, (VALUES ('direct'), ('indirect'), ('indirect_overt')) x(p), (VALUES ('labeled'), ('unlabeled')) z(c), range(1, 3) y(r)")
def context_manifest(spark, sf_dir):
    """J20"""
    quotes = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("quote_id"), F.col("text").alias("quote"))
    return requests.manifest(quotes, runs=2, contexts=("labeled", "unlabeled")).select("request_id", "prompt_type", "context_variant", "run")


_Q = {k: v.replace("'", "''").split("{passage}") for k, v in text.PROMPTS.items()}
_CASE = "CASE prompt_type " + " ".join(f"WHEN '{k}' THEN '{a}' || quote || '{b}'" for k, (a, b) in _Q.items()) + " END"


@query(f"WITH {_MANIFEST} SELECT request_id, sha256({_CASE}) AS prompt_sha256 FROM manifest")
def rendered_prompts(spark, sf_dir):
    """X10, X16"""
    return requests.with_prompt(_manifest(spark, sf_dir)).select("request_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"WITH {_MANIFEST} SELECT request_id, provider, sha256({_CASE}) AS prompt_sha256, CASE WHEN provider <> 'contents' THEN 'm' END AS model, provider <> 'contents' AS told FROM manifest, (VALUES ('chat'), ('responses'), ('messages'), ('contents')) b(provider)")
def request_bodies(spark, sf_dir):
    """Request lines of four providers through text files; the prompt and the system message read back from each."""
    rows, frames = requests.with_prompt(_manifest(spark, sf_dir)), []
    places = {
        "chat": ("custom_id", "body.messages[1].content", "body.model", "body.messages[0].content"),
        "responses": ("custom_id", "body.input", "body.model", "body.instructions"),
        "messages": ("custom_id", "params.messages[0].content", "params.model", "params.system"),
        "contents": ("key", "request.contents[0].parts[0].text", "none", "none"),
    }
    for provider, (key, prompt, model, told) in places.items():
        path = scratch.folder(spark)
        sinks.write_text(requests.batch_body(rows, provider, "m"), path)
        get = lambda p: F.get_json_object("value", f"$.{p}")
        line = spark.read.text(path)
        frames.append(line.select(get(key).alias("request_id"), F.lit(provider).alias("provider"), F.sha2(get(prompt), 256).alias("prompt_sha256"), get(model).alias("model"), F.coalesce(get(told) == requests.SYSTEM, F.lit(False)).alias("told")))
    return reduce(lambda a, b: a.union(b), frames)


def _lines(spark, sf_dir):
    """Batch result lines made of events: some with output_text, some with parts, some failed."""
    part = F.struct(F.lit("output_text").alias("type"), F.col("event_type").alias("text"))
    message = F.struct(F.lit("message").alias("type"), F.array(part, part).alias("content"))
    e = table(spark, sf_dir, "events")
    ok, own = F.col("event_id") % 5 != 0, F.col("event_id") % 2 == 0
    body = F.struct(F.when(own, F.col("event_type")).alias("output_text"), F.when(~own, F.array(message)).alias("output"))
    status = F.when(ok, 200).otherwise(400)
    return e.select("event_id", F.to_json(F.struct(F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("custom_id"), F.struct(status.alias("status_code"), body.alias("body")).alias("response"))).alias("value"))


@query("SELECT 'req_' || event_id AS custom_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || event_type END AS llm_output, event_id % 5 = 0 AS failed, CASE WHEN event_id % 5 = 0 THEN 400 ELSE 200 END AS http_status FROM events")
def ingested_results(spark, sf_dir):
    """Failed means an error text was found."""
    return scans.batch_results(_lines(spark, sf_dir)).select("custom_id", "llm_output", (F.col("error") != "").alias("failed"), "http_status")


@query("SELECT event_id AS idx, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || event_type END AS text FROM events")
def indexed_results(spark, sf_dir):
    """S11"""
    return scans.indexed_results(_lines(spark, sf_dir))


@query("SELECT event_id, event_type AS content, event_type || '!' AS candidate FROM events")
def message_contents(spark, sf_dir):
    """D3, D4"""
    e = table(spark, sf_dir, "events")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("message"))).alias("choices")))
    parts = F.array(F.struct(F.col("event_type").alias("text")), F.struct(F.lit("!").alias("text")))
    gem = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates")))
    return e.select("event_id", nested.message_content(chat).alias("content"), nested.candidate_text(gem).alias("candidate"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS hits, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS strict_hits FROM events")
def search_hits(spark, sf_dir):
    """A missing count is 0 for one caller and no hit for the other."""
    e = table(spark, sf_dir, "events")
    result = F.array(F.struct(F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("se_results_count")))
    code = F.when(F.col("event_id") % 3 == 0, 40000).otherwise(20000)
    body = F.to_json(F.struct(F.lit(20000).alias("status_code"), F.array(F.struct(code.alias("status_code"), result.alias("result"))).alias("tasks")))
    return e.select("event_id", nested.hit_count(body, 0).alias("hits"), nested.hit_count(body).alias("strict_hits"))


@query("SELECT event_id, 'Q' || user_id AS claim, event_type AS label, replace(event_type || ' x y', 'x y', 'x y') AS name, 'y x ' || event_type AS turned FROM events")
def knowledge_claims(spark, sf_dir):
    """D7, D9, S20"""
    e = table(spark, sf_dir, "events")
    claim = F.to_json(F.create_map(F.lit("P21"), F.array(F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("id")).alias("value")).alias("datavalue")).alias("mainsnak")))))
    labels = F.to_json(F.create_map(F.lit("en"), F.struct(F.col("event_type").alias("value"))))
    name = F.concat("event_type", F.lit(" x y"))
    return e.select("event_id", nested.claim_id(claim, "P21").alias("claim"), nested.label(labels).alias("label"), name.alias("name"), nested.reversed_name(name).alias("turned"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(string_split(event_type, '_')) AS tokens FROM events")
def event_properties(spark, sf_dir):
    """D8"""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), nested.n_tokens(F.split("event_type", "_")).alias("tokens"))


@query(f"WITH {_MANIFEST} SELECT m.request_id, coalesce(c.role, '') AS llm_output FROM manifest m LEFT JOIN conversations c ON m.quote_id = c.conv_id || '-' || c.turn AND m.run = 1 AND c.turn % 2 = 0")
def joined_responses(spark, sf_dir):
    """Every request, missing text as blank."""
    m = _manifest(spark, sf_dir)
    r = table(spark, sf_dir, "conversations").where("turn % 2 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("quote_id"), F.lit(1).alias("run"), F.col("role").alias("llm_output"))
    answers = m.join(r, ["quote_id", "run"]).select("request_id", "llm_output")
    return joins.with_responses(m, answers, "request_id").select("request_id", "llm_output")


@query("WITH last AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT c_custkey AS key, s IS NOT NULL AS reused, s FROM customer LEFT JOIN last ON c_custkey = o_custkey")
def reuse_split(spark, sf_dir):
    """Reusable rows and pending rows together are all rows."""
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    earlier = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderstatus").alias("s"))
    old, new = joins.split_reusable(m, earlier, "key", "o_orderkey", ["s"])
    return old.select("key", F.lit(True).alias("reused"), "s").union(new.select("key", F.lit(False), F.lit(None).cast("string")))


@query("WITH e AS (SELECT o_custkey AS k, o_orderpriority AS p, arg_max(o_orderstatus, o_orderkey) AS q, arg_max(o_orderkey, o_orderkey) AS v FROM orders GROUP BY ALL) SELECT o_orderkey, CASE WHEN trim(o_orderstatus) = trim(q) THEN v END AS llm_output FROM orders JOIN e ON o_custkey = k AND o_orderpriority = p")
def reused_same_text(spark, sf_dir):
    """Reused only where the text is the same."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("quote"))
    earlier = o.withColumn("llm_output", F.col("o_orderkey"))
    return joins.reuse_same(o, earlier, ["o_custkey", "o_orderpriority"], ["quote"], "o_orderkey").select("o_orderkey", "llm_output")


@query(f"""WITH {CUSTOMERS}, c AS (SELECT doc_id AS idx, CAST(doc_id % 300 AS VARCHAR) AS qid, trim(text) AS q FROM documents), t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 300 AS VARCHAR) ELSE 'none' END AS qid, trim(text) AS q FROM documents)
SELECT t.doc_id, coalesce((SELECT min(idx) FROM c WHERE c.qid = t.qid AND c.q = t.q), (SELECT min(idx) FROM c WHERE c.qid = t.qid), (SELECT min(idx) FROM c WHERE c.q = t.q)) AS retrieval_idx FROM t""")
def retrieval_rows(spark, sf_dir):
    """By id, then by text."""
    d = table(spark, sf_dir, "documents")
    corpus = d.select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 300).cast("string").alias("quote_id"), F.col("text").alias("quote"))
    targets = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 300).cast("string")).otherwise("none").alias("quote_id"), F.col("text").alias("quote"))
    return joins.retrieval_rows(targets, corpus).select("doc_id", "retrieval_idx")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS author, source FROM documents")
def response_demographics(spark, sf_dir):
    """Own value first, then the dataset's."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("author"))
    return joins.with_demographics(rows, d.select("doc_id", F.col("source").alias("author"), "source"), "doc_id", ["author", "source"])


@query("SELECT conv_id, turn, prompt_type, llm_output FROM (SELECT conv_id, turn, text AS direct, role AS indirect FROM conversations) UNPIVOT INCLUDE NULLS (llm_output FOR prompt_type IN (direct, indirect))")
def wide_to_long(spark, sf_dir):
    """P12"""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("direct_response"), F.col("role").alias("indirect_response"))
    return filters.wide_to_long(rows, ["conv_id", "turn"], ["direct", "indirect", "indirect_overt"])


@query("SELECT doc_id, CASE WHEN trim(coalesce(lang, '')) IN ('', 'nan', 'None', 'fr') AND lang <> 'fr' THEN 'unknown' ELSE lang END AS lang, regexp_replace('direct_' || CASE WHEN doc_id % 2 = 0 THEN 'labeled' ELSE 'unlabeled' END, '_(labeled|unlabeled)$', '') AS prompt, CASE WHEN doc_id % 3 = 0 THEN 'indirect_overt' WHEN doc_id % 3 = 1 THEN 'indirect' ELSE 'direct' END AS base FROM documents")
def prompt_names(spark, sf_dir):
    """P8, P9, P10"""
    d = table(spark, sf_dir, "documents")
    variant = F.concat(F.lit("direct_"), F.when(F.col("doc_id") % 2 == 0, "labeled").otherwise("unlabeled"))
    named = F.when(F.col("doc_id") % 3 == 0, "indirect_overt_x").when(F.col("doc_id") % 3 == 1, "indirect_x").otherwise("direct_x")
    return d.select("doc_id", filters.demographic(F.col("lang")).alias("lang"), filters.base_prompt(variant).alias("prompt"), filters.prompt_by_prefix(named).alias("base"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'blog') THEN 'blog' WHEN contains(lower(url), 'example') THEN 'example' END AS dataset, NOT regexp_matches(url, '(?i)\\blocal\\b') AS remote, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS tag, sha256(url) AS h FROM pages")
def path_names(spark, sf_dir):
    """P13, P20, X14, X16"""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", filters.dataset_of(u, ["blog", "example"]).alias("dataset"), filters.not_local(u).alias("remote"), text.slugify(u).alias("slug"), text.model_tag(u).alias("tag"), text.text_hash(u).alias("h"))


@query("SELECT c_custkey, chr(34) || c_name || chr(34) || ' ' || chr(34) || c_mktsegment || chr(34) AS keyword, CASE c_custkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' END AS choice, c_custkey % 2 = 0 AS flag, coalesce(trim(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END), '') AS cell FROM customer")
def text_scalars(spark, sf_dir):
    """X9, X13, X17, X18"""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    options = F.array(F.lit("red"), F.lit("green"), F.lit("blue"))
    letter = F.when(k % 4 == 0, "a").when(k % 4 == 1, " B ").when(k % 4 == 2, "Blue").otherwise("Z")
    return c.select("c_custkey", text.exact_keyword(F.concat(F.lit('"'), "c_name"), F.col("c_mktsegment")).alias("keyword"), text.decode_choice(letter, options).alias("choice"), text.safe_bool(F.when(k % 2 == 0, " Yes").otherwise("no")).alias("flag"), text.cell(F.when(k % 3 != 0, F.concat(F.lit(" "), "c_name"))).alias("cell"))


@query("SELECT source, lang = 'en' AS need_race, lang = 'de' AS need_gender FROM (SELECT source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source)")
def label_needs(spark, sf_dir):
    """P16"""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("lang") == "en", "LLM").otherwise("x").alias("race_source"), F.when(F.col("lang") == "de", "llm").otherwise("y").alias("gender_source"))
    return filters.needs_query(d, "source", "doc_id")


@query("""SELECT CAST(s AS INTEGER) AS shard, CAST(c AS INTEGER) AS chunk, s * 57 AS first_row, least(n - s * 57, 57) AS n_rows, c * 7 + 1 AS first_run, least(10 - c * 7, 7) AS n_runs, least(n - s * 57, 57) * least(10 - c * 7, 7) * 3 AS requests
FROM (SELECT count(*) AS n FROM orders), range(100000) a(s), range(2) b(c) WHERE s * 57 < n""")
def split_plan(spark, sf_dir):
    """Shards of rows and chunks of runs for all orders, 3 prompts and 10 runs, with at most 1200 requests a batch."""
    rows = table(spark, sf_dir, "orders").count()
    plan = windows.split_plan(spark, rows, 3, 10, 1200, 7)
    return plan.select(*[F.col(c).cast("int" if c in ("shard", "chunk") else "bigint").alias(c) for c in plan.columns])


@query("SELECT c_custkey, CAST(floor((c_custkey - 1) / 128) AS INTEGER) AS chunk FROM customer WHERE c_custkey - 1 BETWEEN 9 AND 999")
def row_slices(spark, sf_dir):
    """Rows 10 to 1000, in chunks."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") - 1).alias("idx"))
    return filters.row_range(c, "idx", 10, 1000).select("c_custkey", windows.chunk(F.col("idx"), 128).alias("chunk"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 30")
def head_rows(spark, sf_dir):
    """The first rows by order, which is the feature."""
    return filters.head(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 30)


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    """P11, O6, a sampling operator."""
    return filters.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query(f"WITH {CUSTOMERS} SELECT author, list_transform(list_sort(list_transform(['white', 'black', 'asian', 'latino'], lambda o: md5(o || ':' || author) || o)), lambda x: x[33:]) AS options FROM customers")
def shuffled_options(spark, sf_dir):
    """Seeded order of answer options."""
    options = F.array(*[F.lit(x) for x in ("white", "black", "asian", "latino")])
    return customers(spark, sf_dir).select("author", windows.shuffled(options, F.col("author")).alias("options"))


_SPOKEN = """scored AS (SELECT c_custkey, 'customer ' || right(c_name, 9) AS form, CASE c_custkey % 6 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'none' WHEN 3 THEN 'correct' WHEN 4 THEN 'none' ELSE 'correct' END AS outcome FROM customer)"""


@query(f"WITH {_SPOKEN} SELECT c_custkey, outcome = 'correct' AS correct, outcome <> 'none' AS any_name, c_custkey % 6 IN (2, 4) AS no_answer, outcome FROM scored")
def scored_responses(spark, sf_dir):
    """Responses that name their author in order, reversed or by the last name, name another, or none."""
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    turned = F.concat(F.substring_index(name, "#", -1), F.lit(", "), F.substring_index(name, "#", 1))
    said = F.when(k == 0, F.concat(F.lit("It was written by "), name, F.lit("."))).when(k == 1, "I think John Smith wrote it.").when(k == 2, "I don't know.").when(k == 3, F.concat(F.lit("That is "), turned)).when(k == 4, "").otherwise(F.concat(F.lit("Surely "), F.substring_index(name, "#", -1), F.lit("!")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.translate("c_name", "#", " ").alias("author"), said.alias("llm_output"))
    return mentions.score_responses(rows, "author", "llm_output").select("c_custkey", "correct", "any_name", "no_answer", "outcome")


@query("SELECT a.c_custkey, b.c_name AS mentioned FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + a.c_custkey % 30 AND b.c_nationkey = a.c_nationkey")
def scoped_mentions(spark, sf_dir):
    """T2 with a scope: a name counts only where its dictionary (here a nation's) has it."""
    c = table(spark, sf_dir, "customer")
    names = mentions.dictionary(c, "c_name", "c_custkey", ["c_nationkey"])
    other = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + F.col("c_custkey") % 30).cast("string"), 9, "0"))
    texts = c.select("c_custkey", "c_nationkey", F.concat(F.lit("Perhaps "), other, F.lit(" said so.")).alias("llm_output"))
    return mentions.mentioned_author(texts, names, "c_custkey", "llm_output", ["c_nationkey"]).select("c_custkey", "mentioned")


@query("SELECT c_custkey AS key, CASE WHEN o.n IS NOT NULL THEN 'seen ' || o.n END AS response FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey")
def replayed_responses(spark, sf_dir):
    """A service replayed from a table."""
    recorded = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit("seen "), F.count(F.lit(1)).cast("string")).alias("response"))
    return providers.Replay(recorded).ask(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT sha256(text) AS hash FROM (SELECT DISTINCT trim(text) AS text FROM conversations) WHERE sha256(text) NOT IN (SELECT sha256(trim(text)) FROM conversations WHERE role = 'user')")
def missing_vectors(spark, sf_dir):
    """Texts whose hash has no vector yet."""
    c = table(spark, sf_dir, "conversations").select("text", "role")
    cache = c.where("role = 'user'").select(text.text_hash(F.col("text")).alias("hash"))
    return providers.missing_vectors(c.select("text"), cache).select("hash")


@query("SELECT c_nationkey, arg_min(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END) AS gender, min(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END) AS race FROM customer GROUP BY c_nationkey")
def first_claims(spark, sf_dir):
    """The first candidate with a value, column by column."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("gender"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("race"))
    return providers.first_success(c, ["c_nationkey"], "c_custkey", ["gender", "race"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey < (SELECT min(x) FROM (SELECT o_orderkey + 1 AS x FROM orders) WHERE x NOT IN (SELECT o_orderkey FROM orders)) AND (SELECT min(o_orderkey) FROM orders) = 0")
def completed_prefix(spark, sf_dir):
    """K7: ordered work up to its first gap."""
    return sinks.completed_prefix(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
