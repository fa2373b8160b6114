"""Mention rules, by hand and against a regular-expression search."""

import random
import re

from pyspark.sql import functions as F

from attrilens.functions import text
from attrilens.operators import mentions


def found(spark, authors, bodies):
    a = spark.createDataFrame([(i, x) for i, x in enumerate(authors)], "i int, author string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(bodies)], "k int, body string")
    names = mentions.dictionary(a, "author", "i")
    return {r["k"]: r["mentioned"] for r in mentions.mentioned_author(t, names, "k", "body").collect()}


def test_tiers(spark):
    authors = ["Martin Luther King Jr", "Ann Leeson", "Bob Leeson the Elder Leeson", "Zoë Quill", "The Sound of Serendipity"]
    bodies = ["as MLK said", "by Leeson, Ann", "it was leeson", "zoe quill!", "the sound of serendipity", "thinking", "Ann Leeson and Zoë Quill", None]
    got = found(spark, authors, bodies)
    assert got == {0: authors[0], 1: "Ann Leeson", 2: authors[2], 3: "Zoë Quill", 6: "Ann Leeson"}


def test_duplicate_names(spark):
    assert found(spark, ["Ann Leeson", "ann  leeson"], ["ann leeson", "leeson ann"]) == {0: "ann  leeson", 1: "Ann Leeson"}


def test_large_dictionary_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(mentions, "BROADCAST_NAMES", 0)
    a = spark.createDataFrame([(0, "Ann Leeson")], "i int, author string")
    t = spark.createDataFrame([(0, "by ann leeson")], "k int, body string")
    hits = mentions.mentioned_author(t, mentions.dictionary(a, "author", "i"), "k", "body")
    assert hits.collect() == [(0, "Ann Leeson")]
    # The join of runs and names, not those inside of the dictionary.
    assert "SortMergeJoin" in hits._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" not in hits._jdf.queryExecution().sparkPlan().toString()


def test_own_author(spark):
    rows = [("by Ann Leeson", "Ann Leeson"), ("Leeson Ann", "Ann Leeson"), ("leesons", "Ann Leeson"), ("mr leeson", "Ann Leeson"), ("mlk jr", "Martin Luther King Jr"), ("king", "Al King"), (None, "Ann Leeson"), ("x", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, a string")
    got = [r[0] for r in df.orderBy("i").select(mentions.author_matches(F.col("b"), F.col("a"))).collect()]
    assert got == [True, True, False, True, True, True, False, False]


def test_equals_regex_search(spark):
    rng = random.Random(4)
    words = ["ann", "bob", "lee", "kim", "zed"]
    authors = list({" ".join(rng.choices(words, k=rng.randint(2, 3))) for _ in range(12)})
    bodies = [" ".join(rng.choices([*words, "x"], k=9)) for _ in range(80)]

    def search(body):
        for names in ({a: a for a in authors}, {}):
            if not names:
                turned = {}
                for a in authors:
                    turned.setdefault(" ".join(reversed(a.split())), a)
                names = turned
            pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")\b")
            if m := pattern.search(body):
                return names[m.group()]
        return None

    got = found(spark, authors, bodies)
    assert [got.get(i) for i in range(len(bodies))] == [search(b) for b in bodies]


def test_score(spark):
    df = spark.createDataFrame([("Ann Leeson", "It is Ann Leeson."), ("Ann Leeson", "By Jane Doe."), ("Ann Leeson", "unknown author")], "author string, out string")
    assert [r["outcome"] for r in mentions.score_responses(df, "author", "out").collect()] == ["correct", "wrong", "none"]
    assert text.NO_ANSWER


def test_any_name_has_ascii_borders_as_in_sql(spark):
    import duckdb

    bodies = ["de. Y. Esboboci\u00f3n los", "\u00e9Ann Lee", "Ann Lee\u00e9", "Ann\x0bLee", "Ann\n Lee", "xAnn Lee", "Ann Leex", "Ann L.", "Ann L.x", "A. B.\u00e9", "Ann-Lee Kim's", "Ann\u00a0Lee", "", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = [r[0] for r in df.orderBy("i").select(text.mentions_any_name(F.col("b"))).collect()]
    want = [bool(duckdb.execute("SELECT regexp_matches(?, ?)", [b, text.NAME_RUN]).fetchone()[0]) for b in bodies]
    assert got == want
