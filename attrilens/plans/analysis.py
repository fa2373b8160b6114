"""Analysis of responses: rates, significance, mentions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, filters, joins, mentions, significance, windows
from .registry import CUSTOMERS, RESPONSES, customers, query, responses, rounded, table

_METRICS = RESPONSES + """, quotes AS (
  SELECT prompt_type, race, gender, quote_id, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN any_name THEN 0.0 ELSE 1.0 END) AS suppression
  FROM responses GROUP BY ALL
), stats AS (
  SELECT prompt_type, race, gender, count(*) AS n_quotes, avg(accuracy) AS mean_accuracy, var_samp(accuracy) AS variance_accuracy, stddev_samp(accuracy) AS std_accuracy, stddev_samp(accuracy) / sqrt(count(*)) AS se_accuracy,
    avg(suppression) AS mean_suppression, var_samp(suppression) AS variance_suppression, stddev_samp(suppression) AS std_suppression, stddev_samp(suppression) / sqrt(count(*)) AS se_suppression
  FROM quotes GROUP BY ALL
)"""


def _stats(spark, sf_dir):
    quotes = significance.quote_metrics(responses(spark, sf_dir), ["prompt_type", "race", "gender", "quote_id"])
    return significance.subgroup_metrics(quotes, ["prompt_type", "race", "gender"])


def _test_sql(metric: str, best: str) -> str:
    return f"""WITH {_METRICS}, marked AS (
  SELECT *, {best}(mean_{metric}) OVER (PARTITION BY prompt_type) AS reference_mean FROM stats
), pairs AS (
  SELECT m.prompt_type, m.race, m.gender, m.mean_{metric} = m.reference_mean AS is_reference,
    min(CASE WHEN m.mean_{metric} = m.reference_mean THEN NULL WHEN sqrt(r.se_{metric} ** 2 + m.se_{metric} ** 2) > 0 THEN abs(m.reference_mean - m.mean_{metric}) / sqrt(r.se_{metric} ** 2 + m.se_{metric} ** 2) END) AS z_other
  FROM marked m JOIN marked r ON m.prompt_type = r.prompt_type AND r.mean_{metric} = r.reference_mean GROUP BY ALL
), tested AS (
  SELECT m.*, p.is_reference, CASE WHEN p.is_reference THEN CASE WHEN m.se_{metric} > 0 THEN 0.0 END ELSE p.z_other END AS z
  FROM marked m JOIN pairs p ON m.prompt_type = p.prompt_type AND m.race = p.race AND m.gender = p.gender
)
SELECT prompt_type, race, gender, n_quotes, round(mean_{metric}, 6) AS metric_mean, round(mean_{metric} - 1.96 * se_{metric}, 6) AS ci_low, round(mean_{metric} + 1.96 * se_{metric}, 6) AS ci_high,
  is_reference, round(z, 6) AS z, is_reference OR coalesce(z <= 1.96, false) AS not_significant,
  is_reference AND count(*) FILTER (WHERE is_reference) OVER (PARTITION BY prompt_type) = 1 AND count(*) FILTER (WHERE NOT is_reference) OVER (PARTITION BY prompt_type) > 0
    AND count(*) FILTER (WHERE NOT is_reference AND coalesce(z > 1.96, false)) OVER (PARTITION BY prompt_type) = count(*) FILTER (WHERE NOT is_reference) OVER (PARTITION BY prompt_type) AS star_on_reference
FROM tested"""


def _tested(spark, sf_dir, metric):
    rows = significance.annotate(_stats(spark, sf_dir), ["prompt_type"], metric)
    return rounded(rows.select("prompt_type", "race", "gender", "n_quotes", F.col(f"mean_{metric}").alias("metric_mean"), "ci_low", "ci_high", "is_reference", "z", "not_significant", "star_on_reference"))


@query(_test_sql("accuracy", "max"))
def significance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, A16, A17, M8, M9, W4, W5, J18 for accuracy."""
    return _tested(spark, sf_dir, "accuracy")


@query(_test_sql("suppression", "min"))
def significance_suppression(spark, sf_dir):
    """The same for suppression, where less is better."""
    return _tested(spark, sf_dir, "suppression")


@query(f"WITH {_METRICS} SELECT prompt_type, race, gender, n_quotes, round(mean_accuracy, 6) AS mean_accuracy, round(variance_accuracy, 6) AS variance_accuracy, round(std_accuracy, 6) AS std_accuracy, round(se_accuracy, 6) AS se_accuracy, round(mean_suppression, 6) AS mean_suppression, round(variance_suppression, 6) AS variance_suppression, round(std_suppression, 6) AS std_suppression, round(se_suppression, 6) AS se_suppression FROM stats")
def subgroup_metrics(spark, sf_dir):
    """A17, J8, N14"""
    return rounded(_stats(spark, sf_dir))


@query(f"WITH {RESPONSES} SELECT prompt_type, quote_id, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN correct THEN 0.0 ELSE 1.0 END), 6) AS suppression FROM responses GROUP BY ALL")
def quote_level_with_context(spark, sf_dir):
    """A16, P15 with context: suppression is not correct."""
    return rounded(significance.quote_metrics(responses(spark, sf_dir), ["prompt_type", "quote_id"], with_context=True))


@query(f"WITH {RESPONSES} SELECT quote_id, prompt_type, round(avg(price), 4) AS mean, round(coalesce(stddev_samp(price), 0.0), 4) AS std FROM responses GROUP BY ALL")
def quote_level_spread(spark, sf_dir):
    """A19"""
    return rounded(aggregates.quote_level_spread(responses(spark, sf_dir), ["quote_id", "prompt_type"], "price"), 4)


@query(f"WITH {RESPONSES} SELECT race, " + ", ".join(f"round(avg(CASE WHEN prompt_type = '{p}' THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END), 6) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")) + " FROM responses GROUP BY race")
def comparison_pivot(spark, sf_dir):
    """A18"""
    rows = responses(spark, sf_dir).withColumn("accuracy", F.col("correct").cast("double"))
    return rounded(aggregates.comparison(rows, "race", "prompt_type", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "accuracy"))


_RATES = """count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS p_correct, round(avg(CASE WHEN NOT correct AND any_name THEN 1.0 ELSE 0.0 END), 6) AS p_wrong,
  round(avg(CASE WHEN NOT correct AND NOT any_name THEN 1.0 ELSE 0.0 END), 6) AS p_none,
  round(sum(CASE WHEN correct AND any_name THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN any_name THEN 1.0 ELSE 0.0 END), 0), 6) AS p_correct_given_name"""


@query(f"WITH {RESPONSES} SELECT race, gender, {_RATES} FROM responses GROUP BY GROUPING SETS ((gender), (race), (race, gender), ())")
def outcome_rates(spark, sf_dir):
    """A23, A26, A31, A32 in one pass over grouping sets."""
    return rounded(aggregates.outcome_rates(responses(spark, sf_dir), [("gender",), ("race",), ("race", "gender"), ()]).drop("grouping_bits"))


@query(f"WITH {RESPONSES} SELECT race, gender, {_RATES} FROM responses r WHERE prompt_type <> '1-URGENT' AND quote_id IN (SELECT quote_id FROM responses WHERE prompt_type = '1-URGENT' AND correct) GROUP BY race, gender")
def rates_given_direct_correct(spark, sf_dir):
    """A25, J11"""
    return rounded(aggregates.given_direct_correct(responses(spark, sf_dir), ["race", "gender"], direct="1-URGENT"))


@query(f"WITH {RESPONSES} SELECT prompt_type, race, count(*) AS n, count(*) FILTER (WHERE NOT any_name) AS no_name, round(avg(CASE WHEN any_name THEN 0.0 ELSE 1.0 END), 6) AS no_name_rate FROM responses GROUP BY ALL")
def no_name_rates(spark, sf_dir):
    """A24, A32"""
    return rounded(aggregates.no_name_rates(responses(spark, sf_dir), ["prompt_type", "race"]))


@query(f"WITH {RESPONSES} SELECT count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS p_final FROM responses WHERE any_name")
def final_given_reasoning(spark, sf_dir):
    """A27"""
    return rounded(aggregates.final_given_reasoning(responses(spark, sf_dir), "any_name", "correct"))


#: Wrong answers: the named author is the next customer.
_ERRORS = RESPONSES + ", errors AS (SELECT row_id, author, author % (SELECT max(author) FROM customers) + 1 AS mentioned FROM responses WHERE NOT correct AND any_name)"


def _errors(spark, sf_dir):
    # One number.
    most = customers(spark, sf_dir).agg(F.max("author")).first()[0]
    return responses(spark, sf_dir).where("not correct and any_name").select("row_id", "author", (F.col("author") % most + 1).alias("mentioned"))


@query(f"WITH {_ERRORS} SELECT count(*) AS n, round(avg(CASE WHEN a.race = b.race THEN 1.0 ELSE 0.0 END), 6) AS same_race, round(avg(CASE WHEN a.gender = b.gender THEN 1.0 ELSE 0.0 END), 6) AS same_gender, round(avg(CASE WHEN a.race = b.race AND a.gender = b.gender THEN 1.0 ELSE 0.0 END), 6) AS same_both FROM errors e JOIN customers a ON e.author = a.author JOIN customers b ON e.mentioned = b.author")
def misattribution(spark, sf_dir):
    """A28, J17"""
    people = customers(spark, sf_dir).select("author", "race", "gender")
    return rounded(aggregates.misattribution(joins.demographic_pairs(_errors(spark, sf_dir), people)))


@query(f"WITH {_ERRORS} SELECT author, mentioned, count(*) AS n, min(row_id) AS first_seen FROM errors GROUP BY ALL ORDER BY n DESC, first_seen LIMIT 50")
def author_confusions(spark, sf_dir):
    """A top-k report."""
    return aggregates.confusions(_errors(spark, sf_dir), "author", "mentioned", "row_id")


@query(f"WITH {_ERRORS} SELECT a.race || '/' || a.gender AS true_group, b.race || '/' || b.gender AS named_group, count(*) AS n FROM errors e JOIN customers a ON e.author = a.author JOIN customers b ON e.mentioned = b.author GROUP BY ALL")
def demographic_confusions(spark, sf_dir):
    """A30"""
    pairs = joins.demographic_pairs(_errors(spark, sf_dir), customers(spark, sf_dir).select("author", "race", "gender"))
    return pairs.groupBy(F.concat_ws("/", "true_race", "true_gender").alias("true_group"), F.concat_ws("/", "named_race", "named_gender").alias("named_group")).agg(F.count(F.lit(1)).alias("n"))


_PHRASES = " OR ".join("contains(lower(text), '{}')".format(p.replace("'", "''")) for p in text.NO_ANSWER)


@query(f"SELECT role, round(avg(coalesce(length(text), 0)), 4) AS mean_length, round(avg(CASE WHEN coalesce(text = '' OR {_PHRASES}, true) THEN 1.0 ELSE 0.0 END), 6) AS no_answer_rate FROM conversations GROUP BY role")
def response_lengths(spark, sf_dir):
    """A33, X7"""
    rows = table(spark, sf_dir, "conversations").withColumn("no_answer", text.no_answer(F.col("text")))
    found = aggregates.response_lengths(rows, "role", "text", "no_answer")
    return found.select("role", F.round("mean_length", 4).alias("mean_length"), F.round("no_answer_rate", 6).alias("no_answer_rate"))


@query(f"WITH {RESPONSES}, rates AS (SELECT race, prompt_type, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS p FROM responses GROUP BY ALL) SELECT race, arg_max(prompt_type, (p, prompt_type)) AS best, arg_min(prompt_type, (p, prompt_type)) AS worst, round(max(p) - min(p), 6) AS gap FROM rates GROUP BY race")
def prompt_gaps(spark, sf_dir):
    """A34"""
    rates = responses(spark, sf_dir).groupBy("race", "prompt_type").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return rounded(aggregates.gaps(rates, ["race"], "prompt_type", "p"))


@query("SELECT o_custkey AS unit FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5")
def complete_units(spark, sf_dir):
    """A36, A37"""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), "o_orderpriority")
    return aggregates.complete_units(rows, ["unit"], "o_orderpriority", "o_orderpriority", 5)


@query("WITH wide AS (SELECT conv_id, role, text AS direct, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS indirect FROM conversations) SELECT conv_id, role FROM wide GROUP BY ALL HAVING max((CASE WHEN trim(coalesce(direct, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(indirect, '')) <> '' THEN 1 ELSE 0 END)) = 2")
def complete_units_wide(spark, sf_dir):
    """A36 wide, N7"""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("text").alias("direct"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("indirect"))
    return aggregates.complete_units_wide(rows, ["conv_id", "role"], ["direct", "indirect"])


@query("SELECT c_mktsegment, greatest(count(*) * 3 - count(*) FILTER (WHERE c_acctbal > 0) * 4, 0) AS pending, round(100 - round(avg(c_acctbal) / 1000, 3) - 10, 3) AS wrong FROM customer GROUP BY c_mktsegment")
def pending_and_wrong(spark, sf_dir):
    """A38, A40"""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("d"), F.round(F.avg("c_acctbal") / 1000, 3).alias("a"))
    return c.select("c_mktsegment", aggregates.pending_count(F.col("n") * 3, F.col("d") * 4).alias("pending"), aggregates.wrong_percent(F.col("a"), F.lit(10)).alias("wrong"))


@query("""WITH r AS (SELECT quality = toxic AS a, lower(trim(lang)) = lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' EN ' ELSE upper(lang) END)) AS b FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS n, round(avg(CAST(a AS INT)), 6) AS agree_label, round(avg(CAST(b AS INT)), 6) AS agree_lang, round(avg(CAST(a AND b AS INT)), 6) AS agree_all FROM r""")
def label_agreement(spark, sf_dir):
    """A39"""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    other = F.when(F.col("doc_id") % 3 == 0, " EN ").otherwise(F.upper("lang"))
    rows = rows.select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t"), "lang", other.alias("other"))
    return rounded(aggregates.agreement(rows, {"label": ("q", "t"), "lang": ("lang", "other")}))


@query("SELECT count(*) FILTER (WHERE length(trim(o_orderstatus)) > 0 AND o_orderstatus = 'P') AS errors FROM orders")
def error_totals(spark, sf_dir):
    """A41"""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus")).otherwise("").alias("error"))
    return aggregates.error_count(rows)


@query(f"WITH {CUSTOMERS} SELECT author, CASE gender WHEN 'female' THEN 'F/' ELSE 'M/' END || upper(race[1]) || race[2:] AS label, race AS plain, gender || '_' || race AS ordered FROM customers")
def subgroup_labels(spark, sf_dir):
    """P17, P18"""
    c = customers(spark, sf_dir)
    return c.select("author", filters.subgroup_label(F.col("race"), F.col("gender"), True).alias("label"), filters.subgroup_label(F.col("race"), F.col("gender"), False).alias("plain"), filters.subgroup_order(F.concat_ws("-", "race", "gender")).alias("ordered"))


_WORDS = r"trim(regexp_replace(lower(strip_accents({})), '[^\pL\pN_]+', ' ', 'g'), ' ')"
_STOP = ", ".join(f"'{w}'" for w in text.LAST_NAME_STOPWORDS)
_NAMES = f"""names0 AS (
  SELECT item_id, string_split({_WORDS.format("text")}, ' ')[1:3] AS w FROM benchmark
), people AS (
  SELECT item_id, array_to_string(w, ' ') AS author FROM names0 WHERE len(w) = 3
), lasts AS (
  SELECT item_id, author, string_split(author, ' ')[3] AS last FROM people
), dict AS (
  SELECT author AS name, 1 AS tier, arg_max(author, item_id) AS author FROM people GROUP BY author
  UNION ALL SELECT array_to_string(list_reverse(string_split(author, ' ')), ' ') AS name, 2, arg_min(author, item_id) FROM people GROUP BY array_to_string(list_reverse(string_split(author, ' ')), ' ')
  UNION ALL SELECT last, 3, arg_min(author, (-length(author), item_id)) FROM lasts WHERE length(last) >= 4 AND last NOT IN ({_STOP}) GROUP BY last
)"""


def _people(spark, sf_dir):
    words = F.slice(F.split(text.normalize_for_match(F.col("text")), " "), 1, 3)
    return table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where(F.size("w") == 3).select("item_id", F.array_join("w", " ").alias("author"))


@query(f"WITH {_NAMES} SELECT name, tier, author FROM dict")
def name_dictionary(spark, sf_dir):
    """The dictionary with its rules for duplicates."""
    names = mentions.dictionary(_people(spark, sf_dir), "author", "item_id")
    return names.where(F.col("tier") != mentions.ALIAS)


@query(f"""WITH {_NAMES}, bodies AS (SELECT doc_id, string_split({_WORDS.format("text")}, ' ') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM bodies),
runs AS (SELECT doc_id, p, k, array_to_string(w[p:p+k-1], ' ') AS name FROM (SELECT *, unnest(range(1, 4)) AS k FROM places) WHERE p + k - 1 <= len(w)),
hits AS (SELECT doc_id, d.author, d.tier, p, name FROM runs JOIN dict d USING (name))
SELECT doc_id, arg_min(author, (tier, p, -length(name), author)) AS mentioned FROM hits GROUP BY doc_id""")
def mentioned_authors(spark, sf_dir):
    """The best mention of each document, by an n-gram hash join."""
    names = mentions.dictionary(_people(spark, sf_dir), "author", "item_id")
    return mentions.mentioned_author(table(spark, sf_dir, "documents").select("doc_id", "text"), names, "doc_id", "text")


@query(f"""WITH {_NAMES}, pick AS (SELECT doc_id, {_WORDS.format("d.text")} AS body, p.author FROM documents d JOIN people p ON p.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, contains(' ' || body || ' ', ' ' || author || ' ') OR contains(' ' || body || ' ', ' ' || array_to_string(list_reverse(string_split(author, ' ')), ' ') || ' ')
  OR (length(string_split(author, ' ')[3]) >= 4 AND string_split(author, ' ')[3] NOT IN ({_STOP}) AND contains(' ' || body || ' ', ' ' || string_split(author, ' ')[3] || ' ')) AS correct FROM pick""")
def author_check(spark, sf_dir):
    """Whether each text names its own author."""
    n = table(spark, sf_dir, "benchmark").count()
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("item_id"))
    return d.join(_people(spark, sf_dir), "item_id").select("doc_id", mentions.author_matches(F.col("text"), F.col("author")).alias("correct"))


@query(f"SELECT conv_id, turn, regexp_matches(text, '{text.NAME_RUN.replace(chr(39), chr(39) * 2)}') AS any_name FROM conversations")
def any_name_mentioned(spark, sf_dir):
    """X6"""
    found = F.when(F.col("text").isNotNull(), text.mentions_any_name(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("any_name"))


@query("SELECT c_custkey, c_custkey % 6 IN (0, 1, 2, 3) AS full_hit, c_custkey % 6 = 5 AS other_hit FROM customer")
def alias_hits(spark, sf_dir):
    """Full names, last names, initials and alternate names, letter case apart; and texts that hold none."""
    k, name, segment = F.col("c_custkey") % 6, F.concat(F.lit("Ann "), "c_mktsegment"), F.lower("c_mktsegment")
    full = F.when(k == 0, F.concat(F.lit("ANN "), segment, F.lit(" wrote"))).when(k == 1, F.concat(F.lit("the "), segment)).when(k == 2, F.concat(F.lit("see a. "), segment)).when(k == 3, F.concat(F.lit("one nick"), F.col("c_custkey").cast("string"), F.lit(" said"))).when(k == 4, "").otherwise("nobody")
    other = F.when(k == 5, F.concat(F.lit("A "), segment)).otherwise("Ann someone else")
    c = table(spark, sf_dir, "customer").select("c_custkey", name.alias("author"), F.concat(F.lit("Nick"), F.col("c_custkey").cast("string")).alias("alt"), full.alias("full_response"), other.alias("other_response"))
    found = mentions.live_unit_flags(c, ["full", "other"], "author", "alt")
    return found.select("c_custkey", F.col("full_hit_author").alias("full_hit"), F.col("other_hit_author").alias("other_hit"))


@query("SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END AS ord FROM orders GROUP BY o_orderpriority")
def listed_order(spark, sf_dir):
    """O2"""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("ord", windows.ordered_by_list("o_orderpriority", ["1-URGENT", "2-HIGH"]).cast("int"))
