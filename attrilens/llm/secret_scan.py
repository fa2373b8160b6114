"""Secret scans over a trigram inverted index (operator 4), in DataFrame functions only.

Each rule's regex is read once on the driver into a Boolean query of trigrams
that every match must hold (in lower case). The index has a posting (trigram,
document) for each trigram that some rule needs; a rule's clauses are met by
intersecting their postings (counting a document's distinct trigrams of a
clause), and only the documents left are verified by the rule's regex. Rules
that no trigram is mandatory for scan every document.

Places are code points. A match's start is the length of what stands before it:
the text is split at the matches, and gaps and matches are summed by a running
window over the few match rows.

Defined results: null and empty texts have no spans; rows that repeat an id and
text get equal results; a document's spans are independent for each rule, so
spans of different kinds may overlap; an empty table gives an empty result;
other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as codes
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of a group that a match must have."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so a bound in the regex finds the runs of [0-9a-f]+ that are long enough.
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Published formats of credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    # With the key's body if its end is there.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\r\n]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("bearer", r"(?i:authorization: bearer) [A-Za-z0-9._~+/-]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,80}:[^\s:/@]{3,80}@"),
)
RULES = BASE + MORE
REDACTED = "[SECRET]"
MOST_STRINGS, MOST_CLASS = 64, 6

#: A query is a set of clauses (or), each a set of trigrams (and); ANY holds the empty clause.
Query = frozenset
ANY: Query = frozenset({frozenset()})


def _and(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x in a for y in b)
    # A clause is idle if a smaller one is there.
    return frozenset(x for x in both if not any(y < x for y in both)) if len(both) <= 256 else min(a, b, key=len)


def _or(queries: list[Query]) -> Query:
    both = frozenset().union(*queries)
    return frozenset(x for x in both if not any(y < x for y in both))


def _of_strings(strings: frozenset) -> Query:
    return _or([frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}) for s in strings])


def _item(op, value) -> tuple[frozenset | None, Query]:
    """(all strings of an item if they are few, trigrams it needs)"""
    if op is codes.LITERAL:
        return frozenset({chr(value).lower()}), ANY
    if op is codes.IN:
        chars: set = set()
        for kind, v in value:
            if kind is codes.LITERAL:
                chars.add(chr(v).lower())
            elif kind is codes.RANGE and v[1] - v[0] < MOST_CLASS:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= MOST_CLASS else (None, ANY)
    if op is codes.SUBPATTERN:
        return _sequence(value[3])
    if op is codes.BRANCH:
        found = [_sequence(x) for x in value[1]]
        full = _or([_and(q, _of_strings(s)) if s is not None else q for s, q in found])
        strings = None if any(s is None for s, _ in found) else frozenset().union(*[s for s, _ in found])
        return (strings, ANY) if strings is not None and len(strings) <= MOST_STRINGS else (None, full)
    if op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and high <= 5 and sum(len(strings) ** k for k in range(low, int(high) + 1)) <= MOST_STRINGS:
            return frozenset("".join(p) for k in range(low, int(high) + 1) for p in product(strings, repeat=k)), ANY
        return None, ANY if low == 0 else query if strings is None else _of_strings(strings)
    if op in (codes.AT, codes.ASSERT, codes.ASSERT_NOT):
        return frozenset({""}), ANY
    return None, ANY


def _sequence(items) -> tuple[frozenset | None, Query]:
    held, query, whole = frozenset({""}), ANY, True
    for op, value in items:
        strings, needed = _item(op, value)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = frozenset(a + b for a in held for b in strings)
            continue
        query = _and(_and(query, _of_strings(held)), needed)
        held, whole = strings if strings is not None else frozenset({""}), False
    return (held, ANY) if whole else (None, _and(query, _of_strings(held)))


def trigram_query(regex: str) -> Query:
    """Clauses of lower-case trigrams, one of which every match of the regex holds whole."""
    strings, query = _sequence(parser.parse(regex))
    return _of_strings(strings) if strings is not None else query


def _key(row_id: Column, text: Column) -> Column:
    """64 bits of hash of a row's id and text."""
    return F.xxhash64(row_id, text)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"), _key(F.col(id_col), text).alias("key"))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, key) for the trigrams that rules need."""
    # The generator makes the lower-case text a column of its own, so it is worked out once a row.
    lowered = keyed.select("key", F.explode(F.array(F.lower("text"))).alias("lower"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("lower"), t))
    return lowered.select("key", F.explode(held).alias("trigram"))


def candidates(keyed: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): documents that meet a rule's query, by intersecting postings."""
    spark = keyed.sparkSession
    clauses = [(kind, k, len(c), t) for kind, q in queries.items() for k, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    # As many rows as the rules have trigrams.
    wanted = F.broadcast(spark.createDataFrame(clauses, "kind string, clause int, size int, trigram string"))
    found = postings(keyed, sorted({t for *_, t in clauses})).join(wanted, "trigram").groupBy("key", "kind", "clause").agg(F.first("size").alias("size"), F.count_distinct("trigram").alias("n"))
    return found.where("n = size").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, number: int):
    """Array of (rule number, order, gap before, length, passes) of a rule's matches."""
    text, regex = F.col("text"), F.lit(rule.regex)
    found, gaps = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, rule.regex, -1)
    value = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    return F.transform(F.arrays_zip(found.alias("m"), value.alias("v")), lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(x["m"]).alias("n"), (F.length(x["v"]) >= rule.least).alias("ok")))


def found_spans(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rule, start, end) of every span; rule is the number of its kind."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    none = "array<struct<rule:int,i:int,gap:int,n:int,ok:boolean>>"
    kinds = candidates(keyed, indexed) if indexed else None
    docs = keyed.join(kinds, "key", "left") if kinds is not None else keyed.withColumn("kinds", F.lit(None).cast("array<string>"))
    parts = []
    for number, rule in enumerate(rules):
        matches = _matches(rule, number).cast(none)
        if rule.kind in indexed:
            parts.append(F.when(F.array_contains("kinds", rule.kind), matches).otherwise(F.array().cast(none)))
        else:
            parts.append(F.when(F.col("text").rlike(rule.regex), matches).otherwise(F.array().cast(none)))
    rows = docs.select("key", F.explode(F.flatten(F.array(*parts))).alias("x")).select("key", "x.*").distinct()
    before = Window.partitionBy("key", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    return rows.select("key", "rule", "ok", "n", end.alias("end")).where("ok").select("key", "rule", (F.col("end") - F.col("n")).alias("start"), "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<start, rule, end, kind>>) of every document, by start and rule."""
    keyed = _keyed(docs, id_col, text_col)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    # A document's spans: bounded by the document.
    spans = found_spans(keyed, rules).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "rule", "end", kind.alias("kind")))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")
    return keyed.select("id", "key").join(spans, "key", "left").select(F.col("id").alias("doc_id"), F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = REDACTED) -> DataFrame:
    """docs with every span, overlapping ones joined, replaced by the mark; columns as in docs."""
    text = docs[text_col].cast("string")
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found_spans(_keyed(docs, id_col, text_col), rules).withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    after = F.lead("start").over(Window.partitionBy("key").orderBy("start"))
    cuts = runs.withColumn("next", after).groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "next"))).alias("_cuts"))
    joined = docs.join(cuts, _key(docs[id_col], text) == cuts["_key"], "left")
    part = lambda start, size: F.call_function("substring", text, (start + 1).cast("int"), size.cast("int"))
    tail = F.array_join(F.transform(cuts["_cuts"], lambda c: F.concat(F.lit(mark), part(c["end"], F.coalesce(c["next"], F.length(text).cast("long")) - c["end"]))), "")
    clean = F.when(cuts["_cuts"].isNull(), text).otherwise(F.concat(part(F.lit(0), F.get(cuts["_cuts"], F.lit(0))["start"]), tail))
    return joined.select(*[clean.alias(c) if c == text_col else docs[c] for c in docs.columns])


def _digest(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = "\n  UNION ALL ".join(
        f"SELECT doc_id, {number} AS rule, {quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(text, {quoted(r.regex)}) AS m, regexp_extract_all(text, {quoted(r.regex)}, {r.group}) AS v, regexp_split_to_array(text, {quoted(r.regex)}) AS gaps FROM documents"
        for number, r in enumerate(rules)
    )
    return f"""
WITH found AS (
  {kinds}
), each AS (
  SELECT doc_id, rule, kind, least, m, v, gaps, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0
), spans AS (
  SELECT doc_id, rule, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start, length(m[i]) AS n
  FROM each WHERE length(v[i]) >= least
), digests AS (
  SELECT doc_id, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, rule) FILTER (WHERE rule < {len(BASE)}) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN digests s ON d.doc_id = s.doc_id
"""


OP4_SQL = _sql()
