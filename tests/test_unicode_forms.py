"""Match form in the JVM against Python's own Unicode functions."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from attrilens.functions import text
from attrilens.functions.unicode_forms import match_words, plain


def test_every_assigned_code_point(spark):
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rows = [(i, f"a{chr(c)}b {chr(c)}") for i, c in enumerate(codes)]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(rows, "i int, s string").repartition(8).select("i", match_words(F.col("s")).alias("w")).collect()}
    wrong = [(hex(codes[i]), s, got[i], plain(s)) for i, s in rows if got[i] != plain(s)]
    assert not wrong, (len(wrong), wrong[:10])


def test_mixed_texts(spark):
    rng = random.Random(2)
    pool = "aZ09_ -'.,\n\t" + "éÉñÑüßœŒÇªº½ﬁﬀ①Ｎ＊" + "ΣσςΑΟΔ" + "한글각" + "日本語" + "ДжЇ" + "אבشر" + "𝐀𝟘😀" + "̧́‍­　"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "ΟΔΟΣ ΣΑΣ", "İstanbul", "ȩ́e", "x" * 100_000 + "é"]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", text.normalize_for_match(F.col("s")).alias("w")).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, (len(wrong), wrong[:5])
    assert spark.createDataFrame([(None,)], "s string").select(text.normalize_for_match(F.col("s"))).first()[0] is None


def test_no_python_in_the_plan(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(text.normalize_for_match(F.col("text")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_runs_between_words(spark):
    """A run of blanks is one step of the pattern, not one of its stack."""
    body = "\u00e9a" + " " * 300_000 + "b\u00f1"
    assert spark.createDataFrame([(body,)], "s string").select(match_words(F.col("s"))).first()[0] == "ea bn"
