"""Construction of balanced author groups: cleaning, fame, deciles, matching, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths, text
from ..operators import aggregates, filters, joins, matching, sets, statistics, windows
from ..sources import scans, sinks
from .registry import CUSTOMERS, FAME, RESPONSES, customers, famous, query, responses, rounded, table

_TENTHS = [k / 10 for k in range(11)]


_SPOKEN = "spoken AS (SELECT conv_id, turn, role, CASE conv_id % 9 WHEN 0 THEN text || ' شكرا' WHEN 1 THEN text || ' Спасибо' WHEN 2 THEN 'Ça ' || text ELSE text END AS text FROM conversations)"


def _spoken(spark, sf_dir):
    """Turns of conversations, some with a word of Arabic, Cyrillic or accented Latin letters added."""
    k = F.col("conv_id") % 9
    text_ = F.when(k == 0, F.concat("text", F.lit(" شكرا"))).when(k == 1, F.concat("text", F.lit(" Спасибо"))).when(k == 2, F.concat(F.lit("Ça "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text_.alias("text"))


@query(f"""WITH {_SPOKEN} SELECT conv_id, turn, trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS norm, len(regexp_extract_all(text, '[\\pL\\pN_]+')) AS words FROM spoken
WHERE trim(text) <> '' AND NOT regexp_matches(text, '[{text.ARABIC}]') AND NOT regexp_matches(regexp_replace(text, '[{text.LATIN}]', '', 'g'), '\\pL') AND len(regexp_extract_all(text, '[\\pL\\pN_]+')) BETWEEN 5 AND 30""")
def clean_quotes(spark, sf_dir):
    """P3, P4, P5, X1"""
    rows = _spoken(spark, sf_dir).withColumns({"race": F.lit("white"), "gender": F.lit("male")})
    kept = filters.clean_quotes(rows, author="role", quote="text", race="race", gender="gender")
    return kept.select("conv_id", "turn", text.normalize_text(F.col("text")).alias("norm"), text.count_words(F.col("text")).alias("words"))


@query(f"WITH {CUSTOMERS} SELECT author, race, gender FROM customers WHERE race || '/' || gender IN ('building/male', 'machinery/female') AND lower(c_name) <> 'customer#000000003'")
def subgroup_filter(spark, sf_dir):
    """P1, P2"""
    c = customers(spark, sf_dir)
    return c.where(filters.in_subgroups(F.col("race"), F.col("gender"), [("building", "male"), ("machinery", "female")]) & filters.not_blocked(F.col("c_name"), ["customer#000000003"])).select("author", "race", "gender")


@query("SELECT doc_id, lang, n FROM (SELECT doc_id, lang, source, n_chars AS n, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def capped_quotes(spark, sf_dir):
    """At most ten quotes an author and subgroup, in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("n"))
    return windows.top_rows(d, ["lang", "source"], [F.col("doc_id")], 10).select("doc_id", "lang", "n")


@query("""SELECT c_custkey, 'Customer ' || c_custkey AS name, CASE c_custkey % 6 WHEN 0 THEN 'Seg ' || c_mktsegment || '; nick' || c_custkey WHEN 1 THEN 'Other ' || c_custkey WHEN 5 THEN 'B; C; Z' ELSE '' END AS alt FROM customer""")
def cleaned_authors(spark, sf_dir):
    """Dashes, brackets, AKA parts, quotes, long lower-case tails, stray marks."""
    k, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    name = F.concat(F.lit("Customer "), key)
    raw = (
        F.when(k == 0, F.concat(F.lit("- "), name, F.lit(" (nick"), key, F.lit(") - Seg "), F.col("c_mktsegment")))
        .when(k == 1, F.concat(name, F.lit(" aka Other "), key))
        .when(k == 2, F.concat(F.lit('"'), name, F.lit('" ')))
        .when(k == 3, F.concat(name, F.lit(" who wrote a   very long tail")))
        .when(k == 4, F.concat(name, F.lit(" ,;")))
        .otherwise(F.concat(name, F.lit(" (Z) A.K.A. C AKA B")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.clean_author(raw).alias("x")).select("c_custkey", "x.name", "x.alt")


@query("SELECT c_custkey, 'Name ' || c_custkey AS name FROM customer")
def canonical_authors(spark, sf_dir):
    """Leading marks, brackets, quotes, AKA parts, titles after a dash, trailing dashes."""
    k, name = F.col("c_custkey") % 5, F.concat(F.lit("Name "), F.col("c_custkey").cast("string"))
    raw = (
        F.when(k == 0, F.concat(F.lit("— "), name, F.lit(' "Nick" (x) «y» - Work')))
        .when(k == 1, F.concat(name, F.lit(" AKA Other")))
        .when(k == 2, F.concat(F.lit("• - "), name, F.lit(" «z»")))
        .when(k == 3, F.concat(name, F.lit("  —")))
        .otherwise(F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("   ")), F.lit(" 'q' (r)")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.canonicalize_author(raw).alias("name"))


@query(f"WITH {FAME} SELECT author, race, gender, hits, round(log10_hits, 6) AS log10_hits, n FROM famous WHERE log10_hits >= 6")
def famous_authors(spark, sf_dir):
    """Authors with their fame."""
    f = filters.fame_floor(famous(spark, sf_dir), floor=6.0)
    return rounded(f.select("author", "race", "gender", "hits", "log10_hits", "n"))


@query(f"WITH {RESPONSES} SELECT author, arg_min(race, row_id) AS race, arg_min(gender, row_id) AS gender, round(arg_min(price, row_id), 4) AS price, count(*) AS count FROM responses GROUP BY author")
def author_universe(spark, sf_dir):
    """A1"""
    r = aggregates.universe(responses(spark, sf_dir), "row_id", "author", "race", "gender", "price")
    return r.select("author", "race", "gender", F.round("price", 4).alias("price"), "count")


@query("SELECT source, count(DISTINCT lang) AS n_race, count(DISTINCT doc_id % 3) AS n_gender FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1 OR count(DISTINCT doc_id % 3) > 1")
def ambiguous_authors(spark, sf_dir):
    """A2"""
    d = table(spark, sf_dir, "documents").select("source", "lang", (F.col("doc_id") % 3).alias("g"))
    return aggregates.ambiguous(d, "source", "lang", "g")


_GROUPS = "groups AS (SELECT * FROM (VALUES ('building'), ('machinery'), ('automobile'), ('furniture'), ('household'), ('nobody')) r(race), (VALUES ('male'), ('female')) g(gender))"
_RACES = ["building", "machinery", "automobile", "furniture", "household", "nobody"]


def _groups(spark):
    return aggregates.subgroup_table(spark, [(r, g) for r in _RACES for g in ("male", "female")])


@query(f"WITH {FAME}, {_GROUPS} SELECT g.race, g.gender, count(DISTINCT author) AS authors, count(author) AS quotes, count(DISTINCT CASE WHEN hits > 2000000 THEN author END) AS with_hits FROM groups g LEFT JOIN famous f ON g.race = f.race AND g.gender = f.gender GROUP BY ALL")
def subgroup_counts(spark, sf_dir):
    """A3, zero rows kept."""
    rows = famous(spark, sf_dir).withColumn("big", F.when(F.col("hits") > 2_000_000, F.col("hits")))
    return aggregates.subgroup_counts(rows, _groups(spark), "author", "big").select("race", "gender", "authors", "quotes", "with_hits")


_EDGES = f"{FAME}, edges AS (SELECT quantile_cont(log10_hits, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM famous), binned AS (SELECT f.*, len(list_filter(e[2:10], lambda x: x < log10_hits)) AS decile FROM famous f, edges)"


def _binned(spark, sf_dir):
    f = famous(spark, sf_dir)
    edges = aggregates.rising(statistics.exact_quantiles(f, "log10_hits", _TENTHS))
    return f.withColumn("decile", maths.decile_right_closed(F.col("log10_hits"), F.array(*[F.lit(x) for x in edges])))


@query(f"WITH {_EDGES} SELECT author, decile FROM binned")
def fame_deciles(spark, sf_dir):
    """Exact deciles, closed on the right."""
    return _binned(spark, sf_dir).select("author", "decile")


@query(f"WITH {_EDGES}, {_GROUPS} SELECT d.decile, g.race, g.gender, count(DISTINCT b.author) AS authors FROM groups g CROSS JOIN range(10) d(decile) LEFT JOIN binned b ON b.race = g.race AND b.gender = g.gender AND b.decile = d.decile GROUP BY ALL")
def decile_grid(spark, sf_dir):
    """A4: a dense grid of deciles and subgroups."""
    return aggregates.decile_grid(_binned(spark, sf_dir), _groups(spark), "decile", "author", ["race", "gender"]).select(F.col("decile").cast("long").alias("decile"), "race", "gender", "authors")


_TARGETS = f"{FAME}, logs AS (SELECT author, log10(hits + 1.0) AS x FROM famous), e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM logs), placed AS (SELECT author, x, len(list_filter(e, lambda y: y <= x)) AS decile FROM logs, e)"


@query(f"WITH {_TARGETS} SELECT d.decile, count(author) AS target_n FROM range(10) d(decile) LEFT JOIN placed p ON p.decile = d.decile GROUP BY d.decile")
def decile_targets(spark, sf_dir):
    """Quota targets, closed on the left."""
    return aggregates.decile_targets(famous(spark, sf_dir), "hits").select(F.col("decile").cast("long").alias("decile"), "target_n")


@query(f"WITH {_TARGETS} SELECT author, decile FROM (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY x, author) AS rn FROM placed) WHERE rn <= decile + 3")
def quota_fill(spark, sf_dir):
    """The first target_n of each decile in order."""
    f = famous(spark, sf_dir).select("author", maths.log10p1(F.col("hits")).alias("x"))
    found = statistics.exact_quantiles(f, "x", _TENTHS)
    edges = F.array(*[F.lit(e) for e in aggregates.open_edges(found)])
    placed = f.withColumn("decile", maths.decile_left_closed(F.col("x"), edges))
    targets = spark.range(10).select(F.col("id").cast("int").alias("decile"), (F.col("id") + 3).alias("target_n"))
    return windows.quota_fill(placed, targets, "decile", [F.col("x"), F.col("author")]).select("author", F.col("decile").cast("long").alias("decile"))


@query(f"WITH {_EDGES}, q AS (SELECT quantile_cont(n, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM famous) SELECT author, greatest(len(list_filter(list_distinct(e), lambda y: y < n)) - 1, 0) + 1 AS bin FROM famous, q")
def quantile_bins(spark, sf_dir):
    """From 1, repeated edges dropped."""
    f = famous(spark, sf_dir)
    edges = statistics.exact_quantiles(f, "n", _TENTHS)
    return f.select("author", maths.quantile_bin(F.col("n"), F.array(*[F.lit(e) for e in edges])).cast("long").alias("bin"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS names FROM customer GROUP BY c_nationkey")
def joined_names(spark, sf_dir):
    """A5"""
    return aggregates.joined_names(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice, arg_min(nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, ''), o_orderkey) AS status FROM orders GROUP BY o_custkey")
def first_known(spark, sf_dir):
    """A15"""
    o = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")))
    return aggregates.first_known(o, "o_custkey", "o_orderkey", ["status"], ["o_totalprice"])


@query("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS n_{s}, count(*) FILTER (WHERE o_orderstatus = '{s}') > 0 AS in_{s}" for s in "FOP") + " FROM orders GROUP BY o_custkey")
def pivot_counts(spark, sf_dir):
    """A14, J9"""
    return aggregates.pivot_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", list("FOP"), "n_")


@query(f"WITH {FAME} SELECT grp, " + ", ".join(f"count({m}) AS n_{m}, round(avg({m}), 6) AS mean_{m}, round(stddev_samp({m}), 6) AS std_{m}, round(median({m}), 6) AS median_{m}" for m in ("log10_hits", "n")) + " FROM famous GROUP BY grp")
def subgroup_balance(spark, sf_dir):
    """A8"""
    return rounded(aggregates.quartet(famous(spark, sf_dir), ["grp"], ["log10_hits", "n"]))


def _p_value(found: str) -> str:
    """SQL for the two-sided p of (scope, n, r): Simpson's rule over Student's density from 0 to t."""
    return f"""found AS ({found}), tested AS (SELECT *, CAST(n AS DOUBLE) - 2 AS v, least(abs(r) * sqrt((n - 2) / greatest(1 - r * r, 1e-300)), 60.0) AS t FROM found WHERE n >= 3),
sums AS (SELECT *, list_sum(list_transform(range(2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END * pow(1 + pow(t * k / 2000.0, 2) / v, -(v + 1) / 2))) AS area FROM tested)
SELECT scope, n, round(r, 6) AS r, round(greatest(1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * t / 6000.0 * area, 0.0), 5) AS p FROM sums"""


def _with_p(found):
    return statistics.with_p_value(found).select("scope", "n", F.round("r", 6).alias("r"), F.round("p", 5).alias("p"))


#: A measure that is nearly independent of fame, so that p values are not all 0.
_OTHER = "(author * 7919) % 1009"


@query(f"WITH {FAME}, " + _p_value(f"SELECT 'fame' AS scope, count(*) AS n, corr(log10_hits, n) AS r FROM famous UNION ALL SELECT 'other', count(*), corr(log10_hits, {_OTHER}) FROM famous"))
def pearson(spark, sf_dir):
    """A9, with p."""
    f = famous(spark, sf_dir).withColumn("other", F.expr(_OTHER).cast("double"))
    found = statistics.pearson(f, "log10_hits", "n").withColumn("scope", F.lit("fame")).unionByName(statistics.pearson(f, "log10_hits", "other").withColumn("scope", F.lit("other")))
    return _with_p(found)


@query(f"WITH {FAME}, ranked AS (SELECT rank() OVER (ORDER BY hits) + (count(*) OVER (PARTITION BY hits) - 1) / 2.0 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b, rank() OVER (ORDER BY {_OTHER}) + (count(*) OVER (PARTITION BY {_OTHER}) - 1) / 2.0 AS c FROM famous), " + _p_value("SELECT 'fame' AS scope, count(*) AS n, corr(a, b) AS r FROM ranked UNION ALL SELECT 'other', count(*), corr(a, c) FROM ranked"))
def spearman(spark, sf_dir):
    """A10, W9, with p."""
    f = famous(spark, sf_dir).withColumn("other", F.expr(_OTHER))
    found = statistics.spearman(f, "hits", "n").withColumn("scope", F.lit("fame")).unionByName(statistics.spearman(f, "hits", "other").withColumn("scope", F.lit("other")))
    return _with_p(found)


@query(f"WITH {FAME}, scopes AS (SELECT 'all_quotes' AS scope, log10_hits, n FROM famous UNION ALL SELECT 'all_authors', arg_min(log10_hits, author), arg_min(n, author) FROM famous GROUP BY author UNION ALL SELECT grp, log10_hits, n FROM famous), " + _p_value("SELECT scope, count(*) AS n, corr(log10_hits, n) AS r FROM scopes GROUP BY scope"))
def correlation_scopes(spark, sf_dir):
    """R and p in each scope."""
    f = famous(spark, sf_dir).withColumn("n", F.col("n").cast("double"))
    return _with_p(statistics.correlation_scopes(f, "log10_hits", "n", "author", "grp", "author"))


@query(f"""WITH {FAME}, pair AS (SELECT hits AS x, race = 'building' AS a FROM famous WHERE race IN ('building', 'machinery')),
steps AS (SELECT x, sum(CASE WHEN a THEN 1.0 / (SELECT count(*) FROM pair WHERE a) ELSE -1.0 / (SELECT count(*) FROM pair WHERE NOT a) END) AS s FROM pair GROUP BY x), gaps AS (SELECT sum(s) OVER (ORDER BY x) AS g FROM steps),
d AS (SELECT max(abs(g)) AS ks, (SELECT count(*) FROM pair WHERE a) AS na, (SELECT count(*) FROM pair WHERE NOT a) AS nb FROM gaps), e AS (SELECT *, sqrt(na * nb / (na + nb)) AS e FROM d), t AS (SELECT *, ks * (e + 0.12 + 0.11 / e) AS t FROM e)
SELECT round(ks, 6) AS ks, round((SELECT avg(x) FROM pair WHERE a) - (SELECT avg(x) FROM pair WHERE NOT a), 2) AS mean_difference, na AS n_a, nb AS n_b, round(CASE WHEN t > 0.2 THEN greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * t * t))))) ELSE 1.0 END, 6) AS p FROM t""")
def ks_distance(spark, sf_dir):
    """A11, with the asymptotic p."""
    found = statistics.ks_statistic(famous(spark, sf_dir), "hits", "race", "building", "machinery")
    p = statistics.ks_p_value(F.col("ks"), F.col("n_a"), F.col("n_b"))
    return found.select(F.round("ks", 6).alias("ks"), F.round("mean_difference", 2).alias("mean_difference"), "n_a", "n_b", F.round(p, 6).alias("p"))


_GROUPS = [f"{race}_{gender}" for race in ("automobile", "building", "furniture", "household", "machinery") for gender in ("female", "male")]


@query(f"""WITH RECURSIVE {FAME}, vals AS (SELECT 'log10_hits' AS metric, grp, log10_hits AS x FROM famous UNION ALL SELECT 'n', grp, CAST(n AS DOUBLE) FROM famous),
of AS (SELECT metric, grp, count(*) AS n, avg(x) AS m FROM vals GROUP BY ALL), pairs AS (SELECT a.metric, a.grp AS group_a, b.grp AS group_b, a.n AS n_a, b.n AS n_b, a.m - b.m AS diff FROM of a JOIN of b ON a.metric = b.metric AND a.grp < b.grp),
steps AS (SELECT p.metric, group_a, group_b, n_a, n_b, diff, x, sum(CASE WHEN v.grp = group_a THEN n_b ELSE -n_a END) AS s FROM pairs p JOIN vals v ON v.metric = p.metric AND v.grp IN (group_a, group_b) GROUP BY ALL),
gaps AS (SELECT *, abs(sum(s) OVER (PARTITION BY metric, group_a, group_b ORDER BY x)) AS g FROM steps),
ks AS (SELECT row_number() OVER () AS id, *, h // gcd(n_a, n_b) AS lim, n_a // gcd(n_a, n_b) AS a, n_b // gcd(n_a, n_b) AS b FROM (SELECT metric, group_a, group_b, n_a, n_b, diff, CAST(max(g) AS BIGINT) AS h FROM gaps GROUP BY ALL)),
walk AS (SELECT id, 0 AS t, [1.0::DOUBLE] || list_transform(range(n_a), lambda i: 0.0::DOUBLE) AS q FROM ks
  UNION ALL SELECT w.id, t + 1, list_transform(range(n_a + 1), lambda i: CASE WHEN i > t + 1 OR t + 1 - i > n_b OR abs(i * b - (t + 1 - i) * a) >= lim THEN 0.0 ELSE (CASE WHEN i > 0 THEN q[i] * (n_a - i + 1) ELSE 0.0 END + CASE WHEN i <= t THEN q[i + 1] * (n_b - (t - i)) ELSE 0.0 END) / (n_a + n_b - t) END) FROM walk w JOIN ks USING (id) WHERE t < n_a + n_b)
SELECT metric, group_a, group_b, n_a, n_b, round(diff, 6) AS mean_difference, round(h / (n_a * n_b), 9) AS ks, round(1.0 - q[n_a + 1], 8) AS p FROM ks JOIN walk w USING (id) WHERE w.t = n_a + n_b""")
def ks_pairs(spark, sf_dir):
    """A11 with J21: all pairs of subgroups and two metrics, with the exact p."""
    found = statistics.with_ks_p(statistics.ks_pairs(famous(spark, sf_dir), "grp", ["log10_hits", "n"], _GROUPS))
    return found.where("ks is not null").select("metric", "group_a", "group_b", "n_a", "n_b", F.round("mean_difference", 6).alias("mean_difference"), F.round("ks", 9).alias("ks"), F.round("p", 8).alias("p"))


_TWO = f"{_EDGES}, q AS (SELECT quantile_cont(n, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM famous), two AS (SELECT b.author, b.decile + 1 AS a, len(list_filter(q.e, lambda x: x < n)) + 1 AS b FROM binned b, q)"


def _two(spark, sf_dir):
    f = _binned(spark, sf_dir)
    edges = statistics.exact_quantiles(f, "n", _TENTHS)
    return f.select("author", (F.col("decile") + 1).alias("a"), (maths.decile_right_closed(F.col("n"), F.array(*[F.lit(e) for e in edges])) + 1).alias("b"))


@query(f"WITH {_TWO} SELECT count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS same, round(avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_1, round(avg(CASE WHEN abs(a - b) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS within_2, round(avg(abs(a - b)), 6) AS mean_abs, max(abs(a - b)) AS max_abs FROM two")
def decile_shifts(spark, sf_dir):
    """A12"""
    return rounded(statistics.decile_shifts(_two(spark, sf_dir), "a", "b"))


@query(f"WITH {_TWO}, grid AS (SELECT x.a, y.b, count(t.author) AS n FROM range(1, 11) x(a) CROSS JOIN range(1, 11) y(b) LEFT JOIN two t ON t.a = x.a AND t.b = y.b GROUP BY ALL) SELECT a, b, n, round(n / greatest(sum(n) OVER (PARTITION BY a), 1), 6) AS share FROM grid")
def decile_crosstab(spark, sf_dir):
    """A13, A22"""
    return rounded(aggregates.crosstab(_two(spark, sf_dir), "a", "b"))


@query(f"WITH {FAME} SELECT race, round(regr_slope(n, log10_hits), 5) AS slope, round(regr_intercept(n, log10_hits), 5) AS intercept, round(corr(log10_hits, n), 6) AS r, round(min(log10_hits), 6) AS x_min, round(max(log10_hits), 6) AS x_max, round(avg(n), 6) AS y_mean FROM famous GROUP BY race")
def line_fits(spark, sf_dir):
    """A20, A21, K11"""
    d = statistics.line_fit(famous(spark, sf_dir), "log10_hits", "n", ["race"])
    return d.select("race", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), *[F.round(c, 6).alias(c) for c in ("r", "x_min", "x_max", "y_mean")])


@query(f"""WITH {FAME}, s AS (SELECT grp, count(*) AS n, pow(count(*), -0.2) * stddev(log10_hits) AS h, min(log10_hits) AS lo, max(log10_hits) AS hi FROM famous GROUP BY grp),
p AS (SELECT *, lo + (hi - lo) * place / 99 AS x FROM s, range(100) r(place))
SELECT grp, CAST(place AS INT) AS place, round(x, 6) AS x, round((SELECT sum(exp(-1.0 * pow((p.x - f.log10_hits) / h, 2) / 2)) FROM famous f WHERE f.grp = p.grp) / (n * h * sqrt(2 * pi())), 6) AS density FROM p""")
def fame_densities(spark, sf_dir):
    """The curves of the violins, 100 points a subgroup."""
    return rounded(statistics.densities(famous(spark, sf_dir), "log10_hits", "grp"))


@query(f"WITH {FAME}, g AS (SELECT race, avg(log10_hits) AS m FROM famous GROUP BY race) SELECT a.race AS race_a, b.race AS race_b, round(a.m - b.m, 6) AS difference FROM g a JOIN g b ON a.race < b.race")
def subgroup_pairs(spark, sf_dir):
    """J21"""
    g = famous(spark, sf_dir).groupBy("race").agg(F.avg("log10_hits").alias("m"))
    return rounded(joins.subgroup_pairs(g, "race", ["m"]).select("race_a", "race_b", (F.col("m_a") - F.col("m_b")).alias("difference")))


@query("WITH s AS (SELECT c_nationkey AS run, count(*) AS a, sum(c_acctbal) AS b FROM customer GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM s) SELECT run, ra AS rank_a, rb AS rank_b, ra + rb AS rank_sum FROM r")
def run_ranks(spark, sf_dir):
    """Rank aggregation over runs."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.count(F.lit(1)).alias("a"), F.sum("c_acctbal").alias("b"))
    return windows.rank_runs(s, [("a", False), ("b", True)]).select("run", "rank_a", "rank_b", "rank_sum")


_OTHERS = ["building_male", "machinery_male", "machinery_female"]
# One step of a run: the nearest author left of each group, by octave of quotes from the reference's own downwards, then of any, then the last.
_PICK = "coalesce(list_min(list_transform(list_filter(p{i}, lambda x: NOT list_contains(t{i}, x.a) AND x.h >= r.h - o{i} AND x.o <= r.o), lambda x: {{'o': -x.o, 'h': x.h, 'c': x.c, 'a': x.a}})), list_min(list_transform(list_filter(p{i}, lambda x: NOT list_contains(t{i}, x.a) AND x.h >= r.h - o{i}), lambda x: {{'o': 0, 'h': x.h, 'c': x.c, 'a': x.a}})), list_max(list_transform(list_filter(p{i}, lambda x: NOT list_contains(t{i}, x.a)), lambda x: {{'o': 0, 'h': x.h, 'c': x.c, 'a': x.a}})))"
_EACH = lambda form: ", ".join(form.format(i=i) for i in range(3))
_MATCHED = f"""WITH RECURSIVE {FAME}, pool AS (SELECT grp, log10_hits AS h, n AS c, CAST(author AS VARCHAR) AS a, CAST(floor(log2(n) + 1e-9) AS BIGINT) AS o FROM famous),
refs AS (SELECT run, h, c, a, o, row_number() OVER (PARTITION BY run ORDER BY md5(a || ':' || run), a) AS k FROM pool, range(20) x(run) WHERE grp = 'building_female'),
pools AS (SELECT {", ".join(f"(SELECT list({{'h': h, 'c': c, 'a': a, 'o': o}}) FROM pool WHERE grp = '{g}') AS p{i}" for i, g in enumerate(_OTHERS))}),
walk AS (SELECT run, 0::BIGINT AS k, 0::BIGINT AS m, false AS ok, {_EACH("0.0::DOUBLE AS o{i}")}, {_EACH("[]::VARCHAR[] AS t{i}")}, {_EACH("NULL::STRUCT(o BIGINT, h DOUBLE, c BIGINT, a VARCHAR) AS x{i}")} FROM range(20) x(run)
  UNION ALL SELECT run, k, m + CAST(ok AS BIGINT), ok, {_EACH("CASE WHEN ok THEN o{i} + (x{i}.h - h) ELSE o{i} END")}, {_EACH("CASE WHEN ok THEN list_append(t{i}, x{i}.a) ELSE t{i} END")}, {_EACH("x{i}")}
  FROM (SELECT *, (x0.h - h) * (x0.h - h) + (x1.h - h) * (x1.h - h) + (x2.h - h) * (x2.h - h) < 3.0 AS ok FROM (SELECT s.run, r.k, r.h, m, {_EACH("o{i}")}, {_EACH("t{i}")}, {", ".join(_PICK.format(i=i) + f" AS x{i}" for i in range(3))} FROM walk s JOIN refs r ON r.run = s.run AND r.k = s.k + 1, pools)) WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
met AS (SELECT w.run, w.m - 1 AS m, r.a, r.h, r.c, least(r.c, x0.c, x1.c, x2.c) AS n, x0, x1, x2 FROM walk w JOIN refs r ON r.run = w.run AND r.k = w.k WHERE w.ok),
matched AS (SELECT CAST(run AS INT) AS run_id, 'building_female' AS grp, a AS author, h AS log10_hits, c AS count, n AS to_sample, CAST(m AS INT) AS match_idx FROM met{"".join(f" UNION ALL SELECT run, '{g}', x{i}.a, x{i}.h, x{i}.c, n, m FROM met" for i, g in enumerate(_OTHERS))})"""


def _matched(spark, sf_dir):
    f = famous(spark, sf_dir).select("grp", "author", "log10_hits", F.col("n").alias("count"))
    return matching.matched_runs(f, "building_female", _OTHERS, runs=20)


@query(f"{_MATCHED} SELECT run_id, grp, author, round(log10_hits, 6) AS log10_hits, count, to_sample, match_idx FROM matched")
def matched_groups(spark, sf_dir):
    """20 seeded runs, sequential within a run; in SQL a recursion over the reference's authors."""
    return rounded(_matched(spark, sf_dir))


_RANK = "rank() OVER (ORDER BY {c} {d}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{k}"


@query(f"""{_MATCHED}, fames AS (SELECT run_id, grp, count(*) AS n, avg(log10_hits) AS fame FROM matched GROUP BY ALL),
spread AS (SELECT run_id, max(n) AS authors_per_group, round(avg(fame), 9) AS avg_fame, round(max(fame) - min(fame), 9) AS fame_range FROM fames GROUP BY run_id),
ref AS (SELECT run_id, match_idx, log10_hits AS ref, to_sample FROM matched WHERE grp = 'building_female'),
errors AS (SELECT run_id, round(sqrt(avg((log10_hits - ref) ** 2)), 9) AS rms_error FROM matched JOIN ref USING (run_id, match_idx) WHERE grp <> 'building_female' GROUP BY run_id),
stats AS (SELECT spread.*, quotes_per_group, rms_error, 1.0::DOUBLE AS squared_error_limit FROM spread JOIN (SELECT run_id, CAST(sum(to_sample) AS BIGINT) AS quotes_per_group FROM ref GROUP BY run_id) USING (run_id) JOIN errors USING (run_id)),
ranked AS (SELECT *, {", ".join(_RANK.format(c=c, d="ASC" if up else "DESC", k=k) for k, (c, up) in enumerate(matching.CRITERIA))} FROM stats)
SELECT * EXCLUDE ({", ".join(f"r{k}" for k in range(5))}), {", ".join(f"r{k} AS rank_{c}" for k, (c, _) in enumerate(matching.CRITERIA))}, {" + ".join(f"r{k}" for k in range(5))} AS rank_sum FROM ranked""")
def matcher_runs(spark, sf_dir):
    """Metrics of each run, best first; metrics are rounded before they are ranked, so ties are ties."""
    stats = rounded(matching.run_stats(_matched(spark, sf_dir), "building_female"), 9)
    return windows.rank_runs(stats, matching.CRITERIA)


@query("SELECT o_custkey AS author, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS hits FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def latest_hits(spark, sf_dir):
    """The last of each author."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("author"), F.struct("o_orderdate", "o_orderkey").alias("ord"), F.col("o_orderkey").alias("hits"))
    return windows.keep_last(o, ["author"], "ord").select("author", "hits")


@query("SELECT c_custkey AS key, coalesce(p.v, b.v) AS v FROM (SELECT c_custkey, c_acctbal AS v FROM customer) b LEFT JOIN (SELECT c_custkey AS k, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 3 = 0) p ON b.c_custkey = p.k")
def overridden_cache(spark, sf_dir):
    """J2"""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    return joins.override(c, c.where("key % 3 = 0").withColumn("v", F.col("v") * 2), "key")


@query("WITH hits AS (SELECT s_name AS author, s_suppkey AS google_hits FROM supplier) SELECT c_nationkey AS clean, arg_min(google_hits, raw) AS google_hits FROM (SELECT DISTINCT c_nationkey, 'Supplier#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0') AS raw FROM customer) x JOIN hits h ON x.raw = h.author GROUP BY 1")
def fame_lookup(spark, sf_dir):
    """One hit for each author, of the least raw name that has one."""
    raw = F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 100).cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("clean"), raw.alias("raw"))
    hits = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("author"), F.col("s_suppkey").alias("google_hits"))
    return joins.fame_of_authors(rows, hits, "clean", "raw")


@query("SELECT DISTINCT trim(c_mktsegment) AS c_mktsegment, min(c_custkey) AS first_seen FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1")
def unique_authors(spark, sf_dir):
    """S7"""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return scans.unique_first_seen(c, "c_mktsegment", "c_custkey")


@query(f"WITH {CUSTOMERS} SELECT race, gender, author, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY race, gender ORDER BY c_acctbal, author) AS a, row_number() OVER (PARTITION BY race, gender ORDER BY c_acctbal DESC, author) AS d FROM customers) WHERE a <= 5 OR d <= 5")
def stratified_pilot(spark, sf_dir):
    """W10"""
    return windows.pilot(customers(spark, sf_dir), ["race", "gender"], "c_acctbal", "author", 5).select("race", "gender", "author", "c_acctbal")


@query("SELECT n_nationkey, arg_min(c_name, c_custkey) AS example FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def example_quotes(spark, sf_dir):
    """W3"""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.col("c_name").alias("example"))
    return windows.keep_first(c, ["n_nationkey"], "c_custkey").join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey").select("n_nationkey", "example")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def pending_authors(spark, sf_dir):
    """Work without the keys that are done."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.pending(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT c_custkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def union_by_key(spark, sf_dir):
    """U1, U2"""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"))
    return sets.union_distinct(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind")), "key")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_orders, b.n AS n_docs FROM (SELECT o_custkey % 50 AS k, count(*) AS n FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT doc_id % 70 AS k, count(*) AS n FROM documents GROUP BY 1) b ON a.k = b.k")
def key_union(spark, sf_dir):
    """U3, J8"""
    a = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.key_union(a, table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 70).alias("k")).agg(F.count(F.lit(1)).alias("n_docs")), ["k"])


@query("SELECT DISTINCT lang, source FROM documents EXCEPT ALL SELECT DISTINCT lang, source FROM documents WHERE lang = 'en'")
def row_difference(spark, sf_dir):
    """U4, U5"""
    d = sets.drop_repeats(table(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])
    return sets.difference(d, d.where("lang = 'en'"))


@query("""SELECT c_custkey, len(bin(c_custkey)) - 1 AS octave, round(sqrt(c_custkey / 7.0 / 3), 6) AS rms, round(CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE sqrt(c_custkey) END, 6) AS std,
round(CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE sqrt(c_custkey) END / nullif(sqrt(c_custkey % 5), 0) END, 6) AS se FROM customer WHERE c_custkey > 0""")
def math_scalars(spark, sf_dir):
    """Octaves, errors filled in from variance and std, and rms."""
    k = F.col("c_custkey")
    std, se = maths.filled_errors(F.when(k % 2 == 0, 2.0), k.cast("double"), F.when(k % 3 == 0, 0.5), k % 5)
    c = table(spark, sf_dir, "customer").where("c_custkey > 0")
    return rounded(c.select("c_custkey", maths.quote_bin(k).alias("octave"), maths.rms(k.cast("double"), F.lit(7.0), F.lit(3.0)).alias("rms"), std.alias("std"), se.alias("se")))


_WANTED = "wanted AS (SELECT c_custkey AS o_custkey, c_custkey % 4 AS to_sample FROM customer)"


@query(f"WITH {_WANTED}, r AS (SELECT o.o_custkey, o_orderkey, to_sample, row_number() OVER (PARTITION BY o.o_custkey ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS rn FROM orders o JOIN wanted w ON o.o_custkey = w.o_custkey) SELECT o_custkey, o_orderkey FROM r WHERE rn <= to_sample")
def sampled_quotes(spark, sf_dir):
    """A seeded choice of each matched author's quotes."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), (F.col("c_custkey") % 4).alias("to_sample"))
    return matching.sample_quotes(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), wanted, "o_custkey", "o_orderkey")


@query("SELECT author, coalesce(n, 0) AS n, counted IS NOT NULL AS counted FROM (SELECT c_custkey AS author, o.n AS n, o.n AS counted FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey)")
def corpus_counts(spark, sf_dir):
    """J6, N10"""
    counts = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("author")).agg(F.count(F.lit(1)).alias("n"))
    found = joins.with_counts(customers(spark, sf_dir).select("author"), counts, "author")
    return found.select("author", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("counted"))


@query(f"WITH {CUSTOMERS} SELECT race, gender, CASE WHEN race = 'building' THEN 'reference' ELSE 'other' END AS role, count(*) AS n FROM customers WHERE race IN ('building', 'machinery') GROUP BY ALL")
def group_roles(spark, sf_dir):
    """P19"""
    return filters.split_groups(customers(spark, sf_dir), "race", "building", ["machinery"]).groupBy("race", "gender", "role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def dataset_rows(spark, sf_dir):
    """N15"""
    return scans.row_count(table(spark, sf_dir, "lineitem"))
