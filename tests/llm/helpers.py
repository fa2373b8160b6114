"""Small fixtures shared by the tests of this folder."""

import random

WORDS = [a + b for a in "ba ke li mo nu ra si to".split() for b in "da fe gi ho ku".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choices(WORDS, k=n))


def documents(spark, texts, extra=False, ids=None):
    rows = [(ids[i] if ids else i, t, None if extra and i % 4 == 1 else "en", None if extra and i % 5 == 2 else f"s{i % 3}", None if t is None or extra and i % 6 == 3 else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        # Names that operators use inside.
        for c in ("key", "id", "fp", "pos", "line", "words", "h1", "place", "kinds", "grp", "word", "c", "slice", "rng", "score", "n", "size", "root", "_own", "_key", "_n_lines", "_n_equal", "_n_near", "_doc", "_gone", "_near", "_kept_id", "_cuts", "half", "kept", "b", "least"):
            df = df.withColumn(c, df["source"])
    return df


def edge_texts():
    """Nulls, empties, blanks, repeats, odd characters, one long text."""
    rng = random.Random(9)
    long = prose(rng, 6000)
    return [None, "", " \n\t\n ", "one", "one two", prose(rng, 30), prose(rng, 30), "é ß ñ 日本語 😀   x", long, long, "a" * 3000, None, "", "x\x00y", "\n".join([prose(rng, 12)] * 4)]


def very_long_texts():
    """A million white-space characters, a line of 2 MB, a word of a megabyte, very many lines."""
    return [" " * 1_000_000 + "x", "\n" * 1_000_001, " ".join(["alpha", "beta", "gamma", "delta"] * 90_000), "ab" * 500_000, "one line of eight words here it is\n" * 30_000]
