"""Spelling variants: automata against plain sets, near words against all pairs, the query's counts on edge rows."""

import random
import zlib
from collections import Counter

import pytest

from attrilens.llm import spelling

from .helpers import documents, edge_texts


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=10):
    """(form, root, n_near, form_n) of each word by comparing all pairs."""
    out = {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= ratio * n else None
        out[w] = [form, None, len(found), words.get(form)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def some_words(rng, n, letters="abé"):
    base = ["".join(rng.choices(letters, k=rng.randint(7, 11))) for _ in range(n // 4)]
    out = {}
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            k, kind = rng.randrange(len(w)), rng.randrange(3)
            w[k : k + (kind > 0)] = [] if kind == 1 else [rng.choice(letters)]
        if len(w) >= 7:
            out["".join(w)] = int(10 ** rng.uniform(0.4, 4))
    return out


def test_automaton_numbers_and_is_minimal():
    rng = random.Random(1)
    words = sorted(some_words(rng, 300))
    a = spelling.Automaton(words)
    assert [a._number(a.start, 0, w, 0) for w in words] == list(range(len(words)))
    assert a._number(a.start, 0, words[0] + "x", 0) == -1
    # No two states accept the same endings.
    endings = lambda s: frozenset([""] if a.final[s] else []) | {c + e for c, (t, _) in a.edges[s].items() for e in endings(t)}
    seen = [endings(s) for s in range(len(a.edges))]
    assert len(set(seen)) == len(seen)


@pytest.mark.parametrize("low,high", [(0, 9), (4, 9), (0, 4), (2, 5)])
def test_one_error(low, high):
    words = sorted(some_words(random.Random(3), 400))
    a = spelling.Automaton(words)
    for w in [x for x in words if len(x) == 9][:60]:
        want = {k for k, v in enumerate(words) if near(w, v) and v[:low] == w[:low] and (high == 9 or v.endswith(w[high:]))}
        assert a.one_error(w, low, high) == want


@pytest.mark.parametrize("most_rows", [10**6, 25, 2])
def test_near_words_against_all_pairs(spark, most_rows):
    words = some_words(random.Random(5), 350)
    words |= {"prefix" + a + b: 2 + i for i, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in "abcdefgh")}
    words |= {a + "suffixes": 3 for a in "abcdefgh"} | {"a" * 40: 7, "a" * 41: 700, "ab" * 30: 5, "ab" * 30 + "a": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variants(df, most_rows=most_rows, rows_per_task=60).collect()}
    assert got == plain(words)


def test_chain_of_forms(spark):
    chain = ["abcdefgh"[: 8 - (k > 0)] + "x" * 0 for k in range(1)] + ["abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    df = spark.createDataFrame([(w, 2 * 10**k) for k, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(df).collect()}
    assert got == {w: (chain[k + 1] if k + 1 < len(chain) else None, chain[-1]) for k, w in enumerate(chain)}


def test_counts_on_edge_rows(spark):
    texts = [*edge_texts(), "ab" * 20_000 + " " + "ba" * 20_000, "ab" * 20_000 + " ÀÉÎÕÜÿ×÷ Straße STRASSEN strassen ŁódźŁódź 1strassen2strassen", "Quantity QUANTITY quantity " * 60]
    ids = [None, *range(1, len(texts))]
    docs = documents(spark, texts, extra=True, ids=ids)
    want = Counter()
    for i, t in zip(ids, texts):
        for r in spelling.RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                want[r] += 1
    got = spelling.counts(docs.union(docs.where("doc_id = 5")))
    for r in spelling.RUN.findall(texts[5].lower()):
        h = zlib.crc32(f"5:{r}".encode())
        r = r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r
        want[r] += len(r) >= 7
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if n >= 2}
    rows = {r["word"]: r["n_near"] for r in spelling.variants(got).collect()}
    assert rows == {w: x[2] for w, x in plain({w: n for w, n in want.items() if n >= 2}).items()}
    assert spelling.variants(spelling.counts(docs.limit(0))).count() == 0
