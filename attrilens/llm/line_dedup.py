"""Line dedup by a deletion-neighbourhood join (operator 1), in DataFrame functions only.

The unit is the word. Lines are compared in a normal form (lower case, runs of
white space as one space). A line of at least ``min_words`` words matches lines
within one word edit (a word replaced, added or removed); shorter lines match
equal lines only. Every line but the earliest of its matches goes: a line is
dropped if an earlier line, by document and position, equals it or is within
the edit bound, whether or not that earlier line is itself kept. Blank lines
always stay.

1. Equal lines: the least place of each distinct line that occurs again, by a
   128-bit hash.
2. A necessary condition thins the lines. One edit leaves the first or the last
   2**k words of a line alone (the largest power with both in the line), so only
   lines that share such a run with another distinct line go on. Shared runs set
   bits of a filter of bounded size, which every line is tested against where it
   is read; its false hits cost work and change nothing. More shared runs than a
   filter holds are joined by key instead.
3. Deletion neighbourhood: each such line emits the hash of every variant with
   one word removed (outside a shared run), with the place of the removal, and of
   itself whole. Lines that share a variant at one place differ in that word; a
   line whole that equals another's variant lacks that word. Keys that one line
   alone has are thinned out by a second filter. Each group of equal keys is
   reduced to its earliest line (a minimum, combined before the shuffle), so a
   group of any size costs a row for each member and no pairs are formed.
4. The edit distance of each line to its group's earliest is verified on the
   words, and verified lines are dropped.

Variants of lines up to ``short_words`` words are hashed in place from the text
left and right of the word; those of longer lines from running exclusive-ors
over their words, so work stays linear in the line.

Defined results: null and empty texts stay as they are; rows that repeat an id
and text count as one document (the same places); rows that share an id with
different texts are ordered by text hash; a document whose lines all go has an
empty text; null ids come first; ids are integers; an empty table gives an
empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A line has an edit bound of one from this many words on: similarity 7/8 at least.
MIN_WORDS, SHORT_WORDS = 8, 256
#: Filters have this many bits for each key, and at most 2**28 (32 MB).
BITS_PER_KEY, MOST_BITS = 64, 28
#: Shared runs beyond 2**MOST_BITS / LEAST_BITS are met by a join, as a filter that is full would let every line through.
LEAST_BITS = 8
#: A place is id * 10**18 + (text hash below 10**9) * 10**9 + position, in 38 digits: it sorts by id, text and position.
_DOC, _POS, _NULL_ID = 10**9, 10**9, -(10**19)
_PLACE = "decimal(38,0)"


def normal(line: Column) -> Column:
    """Lower case, white space as single spaces."""
    lower = F.lower(line)
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(lower, r"[ \t\r\x0b\x0c]+", " ")).otherwise(lower))


def n_words(text: Column) -> Column:
    """Words of a text in normal form, by its spaces."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def _document(id_col: Column, text: Column) -> Column:
    """Order-preserving number of a document."""
    number = F.coalesce(id_col.cast(_PLACE), F.lit(str(_NULL_ID)).cast(_PLACE))
    return (number * F.lit(_DOC) + F.pmod(F.xxhash64(text), F.lit(_DOC))).cast(_PLACE)


def _settled(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns worked out once a row: a generator keeps filters above from copying their expressions."""
    row = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_row")
    return df.select(*keep, row).select(*keep, *[F.col(f"_row.{k}").alias(k) for k in columns])


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, line in normal form), blank lines left out."""
    text = F.col(text_col).cast("string")
    # A text is hashed once, not for each of its lines.
    numbered = _settled(docs.select(F.col(id_col).alias("id"), text.alias("text")), [], doc=_document(F.col("id"), F.col("text")), text=F.col("text"))
    rows = numbered.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return _settled(rows, ["doc", "pos"], line=normal(F.col("raw"))).where("line <> ''")


def _place() -> Column:
    return (F.col("doc") * F.lit(_POS) + F.col("pos")).cast(_PLACE).alias("place")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


class Filter:
    """A set of 64-bit keys as bits of one array, tested in place through a scalar subquery."""

    def __init__(self, keys: DataFrame, n: int):
        size = 1 << min(MOST_BITS, max(16, (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
        self.words = size >> 6
        held = keys.select(self._word(F.col("key")).alias("w"), self._bit(F.col("key")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        every = keys.sparkSession.range(self.words).select(F.col("id").cast("int").alias("w"))
        # One row of at most 2**22 numbers.
        dense = every.join(held, "w", "left").agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("x"))
        self.bits = dense.select(F.col("x.b").alias("bits")).scalar()

    def _word(self, key: Column) -> Column:
        return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(self.words - 1)).cast("int")

    def _bit(self, key: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))

    def has(self, key: Column) -> Column:
        return F.get(self.bits, self._word(key)).bitwiseAND(self._bit(key)) != 0


def _marks(lines: DataFrame, min_words: int) -> DataFrame:
    """A few numbers for each line: its hashes and place, and with an edit bound its words, shortest run and run keys.

    f2 and l2 are the keys of half runs, for lines of just two runs: a line of one word less has those.
    """
    counted = _settled(lines, ["doc", "pos", "line"], words=n_words(F.col("line")))
    bound = F.col("words") >= min_words
    power = F.floor(F.log2(F.col("words").cast("double")) + 1e-9).cast("int") - 1
    sized = _settled(counted, ["doc", "pos", "line", "words"], size=F.when(bound, F.call_function("shiftleft", F.lit(1), power)))
    size, half = F.col("size"), F.when(F.col("words") == F.col("size") * 2, F.shiftright("size", 1))
    key = lambda side, n, sign: F.when(n.isNotNull(), F.xxhash64(F.lit(side), n, F.call_function("substring_index", F.col("line"), F.lit(" "), n * sign)))
    keys = {"f1": key("first", size, 1), "f2": key("first", half, 1), "l1": key("last", size, -1), "l2": key("last", half, -1)}
    return sized.select(*_hashes(F.col("line")), _place(), F.when(bound, F.col("words")).alias("words"), F.coalesce(half, size).alias("run"), *[v.alias(k) for k, v in keys.items()])


def _shared(rows: DataFrame) -> tuple[DataFrame, int]:
    """The keys (key, line) that two distinct lines have, and their number."""
    keys = common.stored(rows.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key"))
    return keys, keys.count()


def _fits(n: int) -> bool:
    """Whether a filter of bounded size has LEAST_BITS bits for each of n keys."""
    return n * LEAST_BITS <= 1 << MOST_BITS


def _with_keys(rows: DataFrame, keys: DataFrame, n: int, tests: dict[str, list[str]]) -> DataFrame:
    """rows with a flag for each test: whether one of its key columns is among the n keys.

    Through a filter (false hits possible) while one has bits enough, else by a
    join on the keys, spread over all tasks. Rows are told apart by h1 and h2.
    """
    if _fits(n):
        held = Filter(keys, n)
        any_of = lambda names: F.coalesce(F.greatest(*[F.coalesce(held.has(F.col(c)), F.lit(False)) for c in names]) if len(names) > 1 else held.has(F.col(names[0])), F.lit(False))
        return _settled(rows, rows.columns, **{name: any_of(names) for name, names in tests.items()})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("test"), F.col(c).alias("key")) for name, names in tests.items() for c in names])).alias("a")
    hits = rows.select("h1", "h2", asked).select("h1", "h2", "a.test", "a.key").where("key is not null").distinct().join(keys, "key", "left_semi")
    found = hits.groupBy("h1", "h2").agg(*[F.max(F.col("test") == name).alias(name) for name in tests])
    return rows.join(found, ["h1", "h2"], "left").select(*rows.columns, *[F.coalesce(name, F.lit(False)).alias(name) for name in tests])


def _near_candidates(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct lines that share a run with another: (h1, h2, place, line, words, lo, hi), lo to hi the places to remove."""
    tested = marks.where("words is not null")
    keys = tested.select(F.col("h1").alias("line"), F.explode(F.filter(F.array("f1", "f2", "l1", "l2"), lambda k: k.isNotNull())).alias("key"))
    shared = _shared(keys)
    marked = _with_keys(tested.select("h1", "h2", "place", "words", "run", "f1", "f2", "l1", "l2"), *shared, {"by_first": ["f1", "f2"], "by_last": ["l1", "l2"]}).where("by_first or by_last")
    lo = F.when(F.col("by_last"), F.lit(0)).otherwise(F.col("run"))
    hi = F.when(F.col("by_first"), F.col("words") - 1).otherwise(F.col("words") - 1 - F.col("run"))
    found = common.stored(marked.select("h1", "h2", "place", "words", lo.alias("lo"), hi.alias("hi")).groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("words", "lo", "hi")]))
    wanted = Filter(found.select(F.col("h1").alias("key")), found.count())
    texts = _settled(lines, ["doc", "pos", "line"], h1=F.xxhash64("line")).where(wanted.has(F.col("h1"))).select("h1", _place(), "line")
    return found.join(texts, ["h1", "place"])


def _short_variants(lines: DataFrame, short_words: int) -> DataFrame:
    """Variants of lines up to short_words + 1 words: the parts left and right of each removed word."""
    rows = lines.where(F.col("words") <= short_words + 1).select("h1", "h2", "place", "line", "words", F.explode(F.sequence("lo", "hi")).alias("i"))
    cut = lambda n: F.call_function("substring_index", F.col("line"), F.lit(" "), n)
    left = F.when(F.col("i") > 0, cut(F.col("i"))).otherwise("")
    right = F.when(F.col("i") < F.col("words") - 1, cut(F.col("i") + 1 - F.col("words"))).otherwise("")
    removed = F.when((F.col("i") > 0) & (F.col("i") < F.col("words") - 1), F.concat(left, F.lit(" "), right)).otherwise(F.concat(left, right))
    return _settled(rows, ["h1", "h2", "place", "i"], v=F.xxhash64(F.lit(0), F.xxhash64(removed), F.col("words") - 1))


def _long_variants(lines: DataFrame, short_words: int) -> tuple[DataFrame, DataFrame]:
    """The same for lines from short_words words on, and their whole keys, by running exclusive-ors of word hashes with their places."""
    words = lines.where(F.col("words") >= short_words).select("h1", "h2", "place", "words", "lo", "hi", F.posexplode(F.split("line", " ")).alias("i", "word"))
    words = words.select("h1", "h2", "place", "words", "lo", "hi", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy("h1", "h2")
    order = line.orderBy("i")
    before = F.coalesce(F.bit_xor("here").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    removed = words.withColumn("gone", before.bitwiseXOR(shifted)).where("i between lo and hi")
    whole = words.groupBy("h1", "h2", "place", "words").agg(F.bit_xor("here").alias("all"))
    return (
        removed.select("h1", "h2", "place", "i", F.xxhash64(F.lit(1), "gone", F.col("words") - 1).alias("v")),
        whole.select("h1", "h2", "place", F.xxhash64(F.lit(1), "all", "words").alias("v")),
    )


def _near(lines: DataFrame, short_words: int) -> DataFrame:
    """Places of the lines within one word edit of an earlier line."""
    long_removed, long_whole = _long_variants(lines, short_words)
    removed = _short_variants(lines, short_words).union(long_removed)
    short_whole = lines.where(F.col("words") <= short_words + 1).select("h1", "h2", "place", F.xxhash64(F.lit(0), F.xxhash64("line"), "words").alias("v"))
    whole = common.stored(short_whole.union(long_whole))
    wholes = Filter(whole.select(F.col("v").alias("key")), whole.count())
    at_place = F.xxhash64("v", "i")
    replaced = Filter(*_shared(removed.select(at_place.alias("key"), F.col("h1").alias("line"))))
    # Variants that another line shares, or that may be a line whole.
    kept = common.stored(removed.where(replaced.has(at_place) | wholes.has(F.col("v"))))
    least = kept.groupBy("v", "i").agg(F.min("place").alias("other"), F.max("place").alias("most")).where("other < most").drop("most")
    found = kept.join(least, ["v", "i"]).where("other < place").select("place", "other")
    pairs = kept.select("v", F.col("place").alias("long")).join(whole.select("v", F.col("place").alias("short")), "v")
    # A line that becomes an earlier whole line, and a whole line that an earlier line becomes.
    found = found.union(pairs.groupBy("long").agg(F.min("short").alias("short")).where("short < long").select("long", "short"))
    found = found.union(pairs.groupBy("short").agg(F.min("long").alias("long")).where("long < short").select("short", "long"))
    text = lines.select("place", F.split("line", " ").alias("a"))
    earlier = lines.select(F.col("place").alias("other"), F.split("line", " ").alias("b"))
    return found.distinct().join(text, "place").join(earlier, "other").where(within_one_edit(F.col("a"), F.col("b"))).select("place").distinct()


def _agree(a: Column, b: Column) -> Column:
    """Number of equal leading words."""
    first_other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first_other == 0, F.least(F.size(a), F.size(b))).otherwise(first_other - 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Word edit distance of at most one."""
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (_agree(a, b) + _agree(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short_words: int = SHORT_WORDS) -> DataFrame:
    """(doc, pos, near): lines that go, doc the place of a document's first line; near if the first of its equals goes for an earlier near line."""
    if min_words < 4:
        raise ValueError("a line with an edit bound needs room for two runs of two words")
    lines = _lines(docs, id_col, text_col)
    marks = common.stored(_marks(lines, min_words))
    again = common.stored(marks.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    repeated = Filter(again.select(F.col("h1").alias("key")), again.count())
    copies = marks.select("h1", "h2", "place").where(repeated.has(F.col("h1"))).join(again, ["h1", "h2"]).where("place <> first").select("place", F.lit(False).alias("near"))
    near = _near(common.stored(_near_candidates(lines, marks)), short_words).withColumn("near", F.lit(True))
    gone = copies.union(near).withColumn("pos", F.pmod(F.col("place"), F.lit(str(_POS)).cast(_PLACE)).cast(_PLACE))
    return gone.select((F.col("place") - F.col("pos")).cast(_PLACE).alias("doc"), F.col("pos").cast("int").alias("pos"), "near")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: dict[str, str] | None = None, **parameters) -> DataFrame:
    """docs with text reduced to the lines that stay; columns as in docs.

    counts names columns to add: keys of it may be n_lines, n_equal and n_near
    (lines, and those that go as equal or as near), values their names.
    """
    counts = counts or {}
    if {x.lower() for x in counts.values()} & {c.lower() for c in docs.columns}:
        raise ValueError("names of counts must be new")
    gone = dropped_lines(docs, id_col, text_col, **parameters)
    taken = [*docs.columns, *counts.values()]
    doc, places, equal, near, row = (common.free_name(c, taken) for c in ("_doc", "_gone", "_equal", "_near", "_row"))
    # One row a document; its size is bounded by the document's own lines.
    by_doc = gone.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("pos").alias(places), F.count_if(~F.col("near")).alias(equal), F.count_if("near").alias(near))
    by_doc = common.stored(by_doc)
    n, text, zero = by_doc.count(), F.col(f"`{text_col}`").cast("string"), F.lit(0).cast("long")
    own = (_document(F.col(f"`{id_col}`"), text) * F.lit(_POS)).cast(_PLACE)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    numbers = lambda found: [{"n_lines": n_lines, "n_equal": F.coalesce(equal, zero) if found else zero, "n_near": F.coalesce(near, zero) if found else zero}[k].alias(v) for k, v in counts.items()]
    # Documents that lose no line stay out of the join, as far as a filter tells.
    touched = Filter(by_doc.select(F.xxhash64(doc).alias("key")), n).has(F.xxhash64(own)) if _fits(n) else F.lit(True)
    same = docs.where(~touched).select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *numbers(False))
    joined = docs.where(touched).select(*columns, own.alias(doc)).join(by_doc, doc, "left")
    # The generator cuts a text once, not for each line that stays.
    part = F.struct(F.when(F.col(places).isNotNull(), F.split(text, "\n", -1)).alias("parts"))
    cut = joined.select(*columns, *numbers(True), places, F.explode(F.array(part)).alias(row))
    parts, left = F.col(f"{row}.parts"), F.col(places)
    # Set difference keeps the order of places and is linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), left)
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    changed = cut.select(*[F.when(left.isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *counts.values())
    return same.union(changed) if _fits(n) else changed


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts={k: k for k in ("n_lines", "n_equal", "n_near")})


OP1_SQL = f"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT doc_id, pos, line, trim(regexp_replace(lower(line), '\\s+', ' ', 'g'), ' ') AS form FROM raw
), firsts AS (
  SELECT form, min((doc_id, pos)) AS first, string_split(form, ' ') AS w FROM lines WHERE form <> '' GROUP BY form
), long AS (
  SELECT form, first, w, len(w) AS n FROM firsts WHERE len(w) >= {MIN_WORDS}
), places AS (
  SELECT form, first, w, n, unnest(range(1, n + 1)) AS i FROM long
), variants AS (
  SELECT form, first, n, i, array_to_string(w[1:i-1] || w[i+1:], ' ') AS v FROM places
), near AS (
  SELECT b.form FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.n = b.n WHERE a.first < b.first
  UNION SELECT b.form FROM variants a JOIN long b ON a.v = b.form WHERE a.first < b.first
  UNION SELECT b.form FROM long a JOIN variants b ON a.form = b.v WHERE a.first < b.first
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce((l.doc_id, l.pos) <> f.first, false) AS equal,
    coalesce((l.doc_id, l.pos) = f.first AND l.form IN (SELECT form FROM near), false) AS near
  FROM lines l LEFT JOIN firsts f ON l.form = f.form
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_equal, 0) AS n_equal, coalesce(m.n_near, 0) AS n_near
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT equal AND NOT near) AS text, count(*) AS n_lines,
    count(*) FILTER (WHERE equal) AS n_equal, count(*) FILTER (WHERE near) AS n_near
  FROM marked GROUP BY doc_id
) m ON d.doc_id = m.doc_id
"""
