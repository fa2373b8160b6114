"""Author mentions in free text as an n-gram hash join.

A name matches on word boundaries. In match form a text is words joined by
single spaces, so that is equality of a run of words: runs up to the longest
name are exploded and joined to the dictionary by hash, and the best hit of each
text is a minimum over (tier, place, length). Tiers: alias, full name, reversed
name, last name. Within a tier the earliest place wins, then the longest name;
last names of one form belong to the author with the longest name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.unicode_forms import let

ALIAS, FULL, REVERSED, LAST = 0, 1, 2, 3


def dictionary(authors: DataFrame, author: str, order: str, scope: list[str] | None = None, normalise=text.normalize_for_match) -> DataFrame:
    """(scope..., name, tier, author): a row for each name form; duplicates are settled by the tier's rule.

    Equal full names: the last author; equal reversed names: the first; equal last names: the longest, then the first.
    """
    scope = scope or []
    # The generator makes the forms columns of their own, so they are computed once and not in each place that uses them.
    forms = F.explode(F.array(F.struct(normalise(F.col(author)).alias("form"), text.last_name(F.col(author), normalise).alias("last")))).alias("x")
    people = authors.select(*scope, F.col(author).alias("author"), F.col(order).alias("_ord"), forms).select(*scope, "author", "_ord", "x.form", "x.last")
    people = people.where((F.col("form") != "") & ~F.col("form").isin(text.NON_PERSON_AUTHORS))
    full = people.groupBy(*scope, F.col("form").alias("name")).agg(F.max_by("author", "_ord").alias("author")).withColumn("tier", F.lit(FULL))
    turned = people.where(F.col("form").contains(" ")).withColumn("name", F.array_join(F.reverse(F.split("form", " ")), " "))
    turned = turned.groupBy(*scope, "name").agg(F.min_by("author", "_ord").alias("author")).withColumn("tier", F.lit(REVERSED))
    last = people.where("last is not null").groupBy(*scope, F.col("last").alias("name")).agg(F.min_by("author", F.struct(-F.length("author"), F.col("_ord"))).alias("author")).withColumn("tier", F.lit(LAST))
    pairs = [(k, canonical) for canonical, names in text.ALIASES.items() for k in dict.fromkeys(" ".join("".join(c if c.isalnum() else " " for c in n).split()) for n in names)]
    aliases = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(c).alias("form")) for a, c in pairs])).alias("x")
    known = full.select(*scope, F.col("name").alias("form"), "author")
    alias = known.select(*scope, "form", "author", aliases).where(F.col("x.form") == F.col("form")).select(*scope, F.col("x.name").alias("name"), "author").withColumn("tier", F.lit(ALIAS))
    columns = [*scope, "name", "tier", "author"]
    return alias.select(*columns).union(full.select(*columns)).union(turned.select(*columns)).union(last.select(*columns))


def word_runs(texts: DataFrame, key: str, body: str, longest: int, scope: list[str] | None = None, normalise=text.normalize_for_match, firsts: DataFrame | list[str] | None = None) -> DataFrame:
    """(scope..., key, name, place, words): runs of up to longest words of each text in match form.

    firsts, if given, has the first words that a run may start with: a list, or a table (first) that is broadcast.
    """
    own = [*(scope or []), key]
    # The generator makes the words a column of their own, so a text is split once and not for each place.
    words = texts.select(*own, F.explode(F.array(F.split(normalise(F.col(body)), " "))).alias("w"))
    # Each place goes on with its own few words, not with the text's array.
    places = F.transform("w", lambda x, i: F.struct(i.alias("place"), x.alias("first")))
    if isinstance(firsts, list):
        # Places are thinned within the row, before any is a row of its own.
        places = F.filter(places, lambda p: p["first"].isin(*firsts))
    found = F.transform(places, lambda p: F.struct(p["place"].alias("place"), F.slice("w", p["place"] + 1, F.lit(longest)).alias("s")))
    placed = words.select(*own, F.explode(found).alias("p")).select(*own, "p.place", F.explode(F.array("p.s")).alias("s"))
    if isinstance(firsts, DataFrame):
        placed = placed.withColumn("first", F.col("s")[0]).join(F.broadcast(firsts), "first", "left_semi")
    runs = F.transform("s", lambda _, i: F.struct(F.array_join(F.slice("s", F.lit(1), i + 1), " ").alias("name"), (i + 1).alias("words")))
    return placed.select(*own, "place", F.explode(runs).alias("x")).select(*own, "place", "x.name", "x.words")


#: A dictionary of at most so many names is broadcast; a larger one is joined by shuffle.
BROADCAST_NAMES = 200_000
#: Up to so many first words are a set in the plan.
LISTED_WORDS = 20_000


def _hits(texts: DataFrame, names: DataFrame, key: str, body: str, scope: list[str], normalise) -> DataFrame:
    """Runs of words that are names. The dictionary is measured first: its longest name and its size."""
    longest, n = names.agg(F.max(F.size(F.split("name", " "))), F.count(F.lit(1))).first()
    small = n <= BROADCAST_NAMES
    firsts = names.select(F.substring_index("name", " ", 1).alias("first")).distinct() if small else None
    if small:
        # At most LISTED_WORDS short strings and one.
        listed = [r["first"] for r in firsts.limit(LISTED_WORDS + 1).collect()]
        firsts = listed if 0 < len(listed) <= LISTED_WORDS else firsts
    runs = word_runs(texts, key, body, longest or 1, scope, normalise, firsts)
    # Without the hint a dictionary over a small file would be broadcast by the file's size.
    return runs.join(F.broadcast(names) if small else names.hint("merge"), [*scope, "name"])


def mentioned_author(texts: DataFrame, names: DataFrame, key: str, body: str, scope: list[str] | None = None, normalise=text.normalize_for_match) -> DataFrame:
    """(key, mentioned): the best hit of each text that has one."""
    scope = scope or []
    hits = _hits(texts, names, key, body, scope, normalise)
    return hits.groupBy(*scope, key).agg(F.min_by("author", F.struct("tier", "place", -F.length("name"), "author")).alias("mentioned"))


def mentions(texts: DataFrame, names: DataFrame, key: str, body: str, scope: list[str] | None = None, normalise=text.normalize_for_match) -> DataFrame:
    """Every (key, author, tier) that a text holds."""
    return _hits(texts, names, key, body, scope or [], normalise).select(*(scope or []), key, "author", "tier").distinct()


def _holds(body: Column, name: Column) -> Column:
    return F.when(name != "", F.contains(F.concat(F.lit(" "), body, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" ")))).otherwise(False)


def author_matches(body: Column, author: Column, normalise=text.normalize_for_match) -> Column:
    """Whether a text names its own author: in order, reversed, by an alias or by the last name."""
    listed = [(canonical, " ".join("".join(c if c.isalnum() else " " for c in n).split())) for canonical, names in text.ALIASES.items() for n in names]

    def forms(b: Column, a: Column, last: Column) -> Column:
        found = _holds(b, a) | (F.contains(a, F.lit(" ")) & _holds(b, F.array_join(F.reverse(F.split(a, " ")), " ")))
        for canonical, name in listed:
            found = found | ((a == canonical) & _holds(b, F.lit(name)))
        return F.coalesce(found | F.coalesce(_holds(b, last), F.lit(False)), F.lit(False))

    own = F.struct(normalise(body).alias("b"), normalise(author).alias("a"), text.last_name(author, normalise).alias("last"))
    return let(own, lambda x: forms(x["b"], x["a"], x["last"]))


def live_unit_flags(rows: DataFrame, responses: list[str], author: str, alt: str | None = None) -> DataFrame:
    """For each prompt's response whether it holds an alias of the author."""
    aliases = text.build_aliases(F.col(author), F.col(alt) if alt else None)
    return rows.withColumns({f"{r}_hit_author": text.contains_alias(F.col(f"{r}_response"), aliases) for r in responses})


def score_responses(rows: DataFrame, author: str, output: str, normalise=text.normalize_for_match) -> DataFrame:
    """Rows with correct, any_name, no_answer and outcome."""
    correct = author_matches(F.col(output), F.col(author), normalise)
    scored = rows.withColumns({"correct": correct, "any_name": correct | text.mentions_any_name(F.col(output)), "no_answer": text.no_answer(F.col(output))})
    return scored.withColumn("outcome", F.when(F.col("correct"), "correct").when(F.col("any_name"), "wrong").otherwise("none"))
