"""Queries with SQL against DuckDB, and the rest against brute force, on whole small tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attrilens.llm import bpe, fingerprints, line_dedup, packing, queries, quality_rules, secret_scan, simhash_dedup, suffix_tree

from ..test_queries import canonical
from . import brute
from .brute import WORD, components, lower
from .helpers import documents, prose

@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = canonical(queries.QUERIES[name](spark, sf).toPandas()), canonical(con.execute(queries.ORACLE_SQL[name]).df())
    assert got.equals(want)


@pytest.mark.parametrize("short_words", [256, 9])
def test_line_dedup_brute(spark, short_words):
    rng = random.Random(2)
    base = [prose(rng, n) for n in (8, 8, 9, 12, 16, 16, 17, 31, 32, 33, 3, 7)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                kind = rng.randrange(3)
                if kind == 0:
                    w[k] = rng.choice(["xx", "yy", w[k - 1]])
                elif kind == 1:
                    w.insert(k, rng.choice(["zz", w[k]]))
                else:
                    del w[k]
            lines.append(rng.choice(["", " ", "\t"]).join(["", "  ".join(w) if rng.random() < 0.2 else " ".join(w)]))
        texts.append("\n".join(lines + ([""] if rng.random() < 0.3 else [])))
    got = [r["text"] for r in line_dedup.dedup_lines(documents(spark, texts), short_words=short_words).orderBy("doc_id").collect()]
    assert got == brute.lines(texts, line_dedup.MIN_WORDS)


@pytest.mark.parametrize("bits", [6, 28])
def test_line_dedup_beyond_the_filter(spark, sf, texts, monkeypatch, bits):
    """With filters too small for the shared runs a join takes their place; the result is the same and no more lines go on than share a run."""
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = sorted(texts)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] or "" for i in ids] == brute.lines([texts[i] for i in ids], line_dedup.MIN_WORDS)


def test_line_dedup_of_many_lines(spark):
    """A document of very many lines, half of them repeated, in linear time."""
    text = "\n".join(f"line {k % 20_000}" for k in range(40_000))
    got = line_dedup.dedup_lines(documents(spark, [text, text])).orderBy("doc_id").collect()
    assert got[0]["text"] == "\n".join(f"line {k}" for k in range(20_000)) and got[1]["text"] == ""


def test_fingerprints(spark, sf, texts):
    got = run(spark, sf, "op2_document_fingerprints")
    ids = sorted(texts)
    better = 0
    for k, i in enumerate(ids):
        text, then = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + then[:n]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if k % 4 == 0 and len(text) < 6000 and len(then) < 6000:
            own, changed, following = text.encode(), edited.encode(), then.encode()
            assert r["fingerprint"] == brute.digest_hex(own) and r["edited_fingerprint"] == brute.digest_hex(changed)
            assert math.isclose(r["near_edited"], brute.likeness(own, changed), abs_tol=1e-12) and math.isclose(r["near_next"], brute.likeness(own, following), abs_tol=1e-12)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        better += r["near_edited"] > r["near_next"] or text == then
    assert len(got) == len(ids) and better >= 0.97 * len(ids)
    long = (" ".join(texts.values()) * 9).encode()[: (1 << 20) + 5000]
    flat = np.frombuffer(long, np.uint8)
    assert fingerprints.counts(long).sum() == sum(len(flat) - j for _, j in fingerprints.TRIPLETS)
    assert fingerprints.likeness(fingerprints.digest(b""), fingerprints.digest(b"some text here")) == 0


def test_neighbours_in_ranges(spark):
    """Ranges of ids, gaps, and negative ids give each row its true successor."""
    rng = random.Random(3)
    ids = rng.sample(range(-50_000, 50_000), 700)
    docs = documents(spark, [f"t{i}" for i in ids], ids=ids)
    old = fingerprints.RANGE_DOCS
    fingerprints.RANGE_DOCS = 40
    try:
        got = fingerprints.with_next(docs, lambda: lambda a, b: (a[0], b[0]), "a long, b long").collect()
    finally:
        fingerprints.RANGE_DOCS = old
    order = sorted(ids)
    nulls, least, starts = fingerprints.range_starts(docs.select(F.col("doc_id").alias("id")), 40, 64)
    assert (nulls, least) == (0, order[0]) and set(starts) <= set(order) and 5 <= len(starts) <= 20
    far = docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 2**62).alias("id"))
    assert max(np.diff(np.searchsorted(sorted(r["id"] for r in far.collect()), [order[0], *fingerprints.range_starts(far, 40, 64)[2]]))) <= 400
    assert {r["a"]: r["b"] for r in got} == {a: order[(k + 1) % len(order)] for k, a in enumerate(order)} and len(got) == len(ids)


def test_packing(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.QUERIES["op3_best_fit_packing"](spark, sf).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    total = 0
    for i, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= -(-total // 2048) + 1


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4, 4, 3, 3]
    assert len(packing.local_search(lengths, [[0, 5], [1, 3], [2, 4], [6]], 10)) == 3
    assert packing.local_search([7, 7], [[0], [1]], 10) == [[0], [1]]
    rng = random.Random(5)
    many = [rng.randint(1, 100) for _ in range(300)]
    bins = packing.pack(many, 100)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(many[i] for i in b) <= 100 for b in bins)


def test_search_needs_fewer_bins_than_best_fit():
    """On lengths drawn evenly from 300 to 900, best fit decreasing leaves bins over the bound; the search empties most of them."""
    for seed in range(3):
        rng = random.Random(seed)
        lengths = [rng.randint(300, 900) for _ in range(2000)]
        first = packing.Bins(2048)
        for n in sorted(range(2000), key=lambda i: -lengths[i]):
            first.add(n, lengths[n])
        least = -(-sum(lengths) // 2048)
        assert len(first.items) - least >= 8 and len(packing.pack(lengths, 2048)) - least <= (len(first.items) - least) / 2


def step_left(lengths, bins, capacity):
    """Whether some document of an underfull bin can go to a fuller end elsewhere, for none, one or two documents."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    for b, given in enumerate(bins):
        for t, gaining in enumerate(bins):
            if b == t or capacity in (fills[b], fills[t]):
                continue
            backs = {0} | {lengths[j] for j in gaining} | {lengths[j] + lengths[k] for j, k in itertools.combinations(gaining, 2)}
            if any(max(fills[b], fills[t]) < fills[t] + lengths[i] - d <= capacity for i in given for d in backs):
                return True
    return False


def test_local_search_ends_only_without_steps():
    """No bound on steps or tries: at the end the bins meet the bound of the total length, or no step is left."""
    for seed, n in ((0, 1000), (1, 1300), (2, 700)):
        rng = random.Random(seed)
        lengths = [rng.randint(300, 900) for _ in range(n)]
        bins = packing.pack(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
        assert len(bins) == -(-sum(lengths) // 2048) or not step_left(lengths, bins, 2048)


def test_every_bin_with_space_is_gathered():
    """One free token is enough for the second round, and that never needs more bins than it got."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "piece": pa.array([0] * 3, pa.int32()), "start": pa.array([0] * 3, pa.int64()), "length": pa.array([2048, 2047, 2020], pa.int64()), "ids_crc32": pa.array([1, 2, 3], pa.int64())})
    out = packing._packer(columns, 2048)((pa.scalar(0),), rows)
    assert out.column("underfull").to_pylist() == [False, True, True]
    assert len(packing.pack([6, 5, 5, 4, 4, 3, 3], 10, [[0, 3], [1, 2], [4, 5, 6]])) == 3


@pytest.mark.parametrize(("group_pieces", "gather"), [(15, 2), (40, 3), (10_000, 16)])
def test_packing_groups(spark, group_pieces, gather):
    """Groups and the second round: every piece once, gapless, unique sequence numbers, few sequences."""
    rng = random.Random(7)
    rows = [(i, 0, 0, rng.choice([100, 100, rng.randint(1, 90)]), rng.getrandbits(32)) for i in range(400)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(parts, len(rows), 100, group_pieces, gather).collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == sorted((r[0], r[3], r[4]) for r in rows)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 100
    groups = -(-len(rows) // group_pieces)
    assert len(places) <= sum(r[3] for r in rows) / 100 + 2 + groups


def test_line_dedup_ids(spark):
    """Order is by id, with ids of any size; null ids come first; equal ids by text."""
    line = prose(random.Random(1), 10)
    other = line.replace(line.split()[4], "changed", 1)
    ids = [2**62, -(2**62), None, 5, 5, 7]
    texts = [line, other, line + "\n" + "tail words", "tail words", "more words here", None]
    got = {(r["doc_id"], r["n"]): r["text"] for r in line_dedup.dedup_lines(documents(spark, texts, ids=ids)).withColumnRenamed("n_chars", "n").collect()}
    assert got == {(2**62, len(line)): "", (-(2**62), len(other)): "", (None, len(texts[2])): texts[2], (5, 10): "", (5, 15): "more words here", (7, None): None}


def test_secrets(spark):
    rng = random.Random(6)
    hexes = "".join(rng.choices("0123456789abcdef", k=40))
    seeds = [
        f'x token = "{hexes}" y', "password:short", "PassWord : 'abcdefghijkl'", "api_key=ABCDEFGHIJKLMNOP apikey=ABCDEFGHIJKLMNOP", "AKIA" + "A1" * 8, "AKIAAKIA", f"ghp_{'a1B2' * 9}",
        "xoxb-1234567890-abcdef", "sk_live_" + "a1" * 9, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.sig", "https://u:pw123@host", "token=api_key:abcdefghijklmnop", "é日 secret = abcdefghijklmn ſecret",
        "-----BEGIN PRIVATE KEY-----\nMIIEvQ/+aB==\nxY9\n-----END PRIVATE KEY----- after", "-----BEGIN EC PRIVATE KEY-----\nMIIEvQ but no end",
        "npm_" + "x" * 36, "AIza" + "b" * 35, "Authorization: Bearer abcdefghijklmnopqrst", "deadbeefdeadbeef" * 3, "DEADBEEFDEADBEEF",
    ]
    texts = [" ".join(rng.sample(seeds, rng.randint(0, 6))) for _ in range(150)] + seeds + ["", "none here"]
    docs = documents(spark, texts)
    got = [[tuple(s) for s in r["spans"]] for r in secret_scan.scan(docs).orderBy("doc_id").collect()]
    assert got == [brute.spans(t) for t in texts]
    red = [r["text"] for r in secret_scan.redact(docs).orderBy("doc_id").collect()]
    assert red == [brute.redacted(t) for t in texts]


def test_trigram_queries_are_necessary():
    for rule in secret_scan.RULES:
        q = secret_scan.trigram_query(rule.regex)
        assert (q == secret_scan.ANY) == (rule.kind == "hex")
    assert secret_scan.trigram_query("abc|x") == secret_scan.ANY
    assert secret_scan.trigram_query("(abcd|efg)+z") == frozenset({frozenset({"abc", "bcd"}), frozenset({"efg"})})


def test_bpe(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, sf, "op5_bpe_encoding")
    for i, text in texts.items():
        e = tok.encode(text, add_special_tokens=False)
        assert got[i]["n_tokens"] == len(e.ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    rng = random.Random(1)
    letters = "abcABCéÉßΣσİıǅﬁ½²٣'sstre!!##$  \t\n\x85\xa0 \x1c日本語हिन्दी😀👍🏽́̀ĀȺⅣ"
    v = bpe.vocabulary()
    for text in ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(600)] + ["<|endoftext|>ab<|startoftext|>", "aaaa" * 400]:
        e = tok.encode(text, add_special_tokens=False)
        assert v.encode(text) == e.ids and v.decode(e.ids) == tok.decode(e.ids, skip_special_tokens=False)


def test_long_words():
    """Words over LONG bytes, one of a megabyte, in time and equal to the library."""
    import string
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    tok, v, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.vocabulary(), random.Random(5)
    for n, letters in ((bpe.LONG + 1, "ab"), (5000, "a"), (5001, "é日a"), (20_000, string.ascii_lowercase), (9000, "the")):
        word = "".join(rng.choices(letters, k=n))
        assert v.merge_long(word.encode()).tolist() == tok.encode(word, add_special_tokens=False).ids
        assert v.encode(f"x {word} y") == tok.encode(f"x {word} y", add_special_tokens=False).ids
    word = "".join(rng.choices(string.ascii_lowercase, k=1_000_000))
    start = time.perf_counter()
    assert v.merge_long(word.encode()).tolist() == tok.encode(word, add_special_tokens=False).ids
    assert time.perf_counter() - start < 15


def test_pieces_by_words():
    """Texts cut at single spaces have the ids of the whole text, whatever was kept before."""
    rng = random.Random(1)
    pieces = quality_rules.Pieces(keep=50)
    for _ in range(1500):
        text = "".join(rng.choices("ab é\n\t  ▁日😀.<\x00", k=rng.randint(0, 30)))
        assert pieces.encode(text).tolist() == pieces.model.encode(text)


def test_quality(spark, sf, texts):
    got = run(spark, sf, "op7_quality_rules")
    for i, text in texts.items():
        r = got[i]
        want = brute.quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model, encoder = quality_rules.piece_model(), packing.byte_encoder()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    passing = [i for i in sorted(texts) if not got[i]["base_failed"] and len(model.encode(texts[i]))]
    rows = []
    for i in passing:
        ids = model.model.encode(texts[i])
        m = brute.measures(texts[i], ids, encoder.encode(texts[i]).tolist(), model.is_byte)
        assert np.allclose(m, [got[i][c] for c in quality_rules.MEASURES])
        rows.append((brute.group(texts[i], langs[i]), int(2 * math.log2(len(ids))), [got[i][c] for c in quality_rules.MEASURES]))
    assert [got[i]["kept"] for i in passing] == brute.verdicts(rows)
    good = [got[i]["kept"] for i, q in labels.items() if q == 1 and i in got and not got[i]["base_failed"]]
    assert np.mean(good) > 0.9
    assert quality_rules.base_measures("a b c d") == (2, 6, 0, 0, 0)


def test_suffix_tree(spark, sf, texts):
    got = run(spark, sf, "op8_suffix_tree_scores")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    sums = [sum(r[c] for i, r in got.items() if held[i]) for c in ("score", "base_score")]
    assert sums[0] > sums[1]


def brute_tree(texts, train, depth, least, least_gain, discount):
    """The model in plain dictionaries: a function of a sequence and a place in it, the kept states, and the root."""
    lists = [["<s>", *WORD.findall(lower(t)), "</s>"] for t in texts]
    after = {}
    for seq, used in zip(lists, train):
        for i in range(1, len(seq)) if used else ():
            for k in range(min(depth, i) + 1):
                after.setdefault(tuple(seq[i - k : i]), Counter())[seq[i]] += 1
    root = after.get((), Counter())
    size = {c: sum(n.values()) for c, n in after.items()}
    states = set()

    def chance(symbol, context):
        if not context:
            return (root[symbol] + 1) / (sum(root.values()) + len(root) + 1)
        p = chance(symbol, context[1:])
        if context not in states:
            return p
        n = after[context]
        return (max(n[symbol] - discount, 0) + discount * len(n) * p) / size[context]

    for context in sorted((c for c in after if c), key=len):
        n, m = after[context], size[context]
        if m < least:
            continue
        gain = 0
        for x, k in n.items():
            p = 2 ** (-round(-suffix_tree.STEPS * math.log2(chance(x, context[1:]))) / suffix_tree.STEPS)
            gain += k * math.log((max(k - 1 - discount, 0) + discount * (len(n) - (k == 1)) * p) / (m - 1) / p) if len(n) > 1 or k > 1 else 0
        if gain >= least_gain:
            states.add(context)
    return lists, chance, states


def brute_scores(texts, train, depth, least, least_gain, discount):
    lists, chance, states = brute_tree(texts, train, depth, least, least_gain, discount)
    return [sum(math.log10(chance(seq[i], tuple(seq[max(0, i - depth) : i]))) for i in range(1, len(seq))) for seq in lists], states


@pytest.mark.parametrize(("depth", "least", "hot", "keys"), [(3, 2, 1 << 17, 1 << 20), (2, 5, 40, 300), (3, 2, 30, 200), (0, 2, 1 << 17, 1 << 20)])
def test_suffix_tree_brute(spark, monkeypatch, depth, least, hot, keys):
    """Scores over many slices, ranges and spread contexts are those of the model in plain dictionaries."""
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        words = rng.choices("abcd", k=3)
        for _ in range(rng.randrange(40)):
            # The next word follows from the last and the third last one, most times.
            words.append("abcd"[(ord(words[-1][0]) + 2 * ord(words[-3][0])) % 4] if rng.random() < 0.7 else rng.choice(["A", "b", f"r{rng.randrange(400)}"]))
        texts.append(" ".join(words))
    texts += [texts[7], texts[8], "", None]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    want, states = brute_scores([t or "" for t in texts], train, depth, least, suffix_tree.LEAST_GAIN, suffix_tree.DISCOUNT)
    assert not depth or {len(c) for c in states} == set(range(1, depth + 1))
    monkeypatch.setattr(suffix_tree, "SLICE_DOCS", 30)
    found = suffix_tree.score_documents(documents(spark, texts).repartition(3), depth=depth, least_count=least, hot_count=hot, range_keys=keys)
    got = {r["doc_id"]: r["score"] for r in found.collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-9)


@pytest.mark.parametrize("copies", [1, 4])
def test_suffix_tree_parts_of_spread_contexts(spark, copies):
    """The parts of spread contexts grow with the tokens, not with contexts times ranges."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(40 * rng.random() ** 2)}" for _ in range(60)) for _ in range(50)] * copies
    docs = documents(spark, texts).coalesce(1).select("doc_id", F.lit(False).alias("held"), "text")
    row = suffix_tree._sliced(docs, "bigint").first().asDict()
    hashes, counts = suffix_tree._word_keys(row["hashes"]), suffix_tree._counts([row["trained"]])
    model = suffix_tree.Model(row["tokens"] + len(texts), len(hashes) + 1, len(texts), 2, 2.0, 0.75, 50, -(-row["tokens"] // 50))
    s = suffix_tree.Slice(row, counts[np.argsort(hashes)] << 1, model)
    s.ask()
    parts = sum(len(x["hot"]) // 4 for x in s.asked())
    assert 0 < parts <= 2 * model.n_all / model.hot_count


def test_suffix_tree_is_a_distribution():
    """Chances of all symbols and of one unknown word sum to one after every state."""
    texts = ["a b a b a c", "a b a b d", "b a c a b"] * 30 + ["x y"]
    lists, chance, states = brute_tree(texts, [True] * len(texts), 2, 2, suffix_tree.LEAST_GAIN, suffix_tree.DISCOUNT)
    symbols = {x for seq in lists for x in seq[1:]} | {"unknown"}
    assert len(states) > 3
    for state in [(), *states]:
        assert math.isclose(sum(chance(x, state) for x in symbols), 1)


def test_suffix_tree_tells_repeated_texts(spark, texts):
    """Texts that occur twice in training are told better than texts that occur once."""
    rng = random.Random(2)
    some = [prose(rng, 60) for _ in range(60)]
    docs = documents(spark, some + some[:20])
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in suffix_tree.score_documents(docs, F.lit(False)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 60)) + 0.2


def test_simhash(spark, sf, texts):
    got = run(spark, sf, "op9_simhash_near_dedup")
    fps = {i: brute.simhash(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    ids = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in got.items()} == components(pairs, ids)


@pytest.mark.parametrize("pair_limit", [1, 4, 1000])
def test_simhash_links(spark, pair_limit):
    """Chains and clouds of fingerprints: both ways of linking a bucket give the true components."""
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                x ^= 1 << rng.randrange(64)
            if rng.random() < 0.2:
                x ^= 7 << rng.randrange(60)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash_dedup.links(df, pair_limit=pair_limit)
    from attrilens.llm.common import components as spark_components

    found = {r["node"]: r["root"] for r in spark_components(edges).collect()}
    pairs = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = components(pairs, signed)
    assert {x: found.get(x, x) for x in signed} == want


def near_texts(rng):
    """Texts and copies with a few words changed, from nearly equal to half different; a hot group; copies."""
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(60, 200)).split()
        texts.append(" ".join(base))
        for changes in (1, 2, 4, 12):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(w))
    hot = [f"w{k}" for k in range(300)]
    for k in range(60):
        texts.append(" ".join(hot[:k] + [f"odd{k}"] + hot[k:]))
    return texts + [texts[0].upper(), texts[0].replace(" ", "  "), "", None, "one", "one two"]


def test_similar_groups_recall(spark):
    """Of pairs at 0.8 to 0.85 that have no other way to meet, nearly all are linked; none below 0.8 is."""
    rng = random.Random(16)
    texts = []
    for _ in range(300):
        base = rng.choices([f"w{k}" for k in range(5000)], k=rng.randint(120, 260))
        other = list(base)
        while brute.alike(" ".join(base), " ".join(other), 0.85):
            other[rng.randrange(len(base))] = f"new{rng.randrange(9999)}"
        texts += [" ".join(base), " ".join(other)]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_groups(documents(spark, texts)).collect()}
    near = [brute.alike(texts[k], texts[k + 1]) for k in range(0, 600, 2)]
    met = [got[k + 1] == k for k in range(0, 600, 2)]
    assert sum(near) > 250 and np.mean([m for m, n in zip(met, near) if n]) >= 0.97
    assert not any(m for m, n in zip(met, near) if not n)


@pytest.mark.parametrize("pair_limit", [16, 1000, 2])
def test_similar_groups(spark, pair_limit):
    """Groups are those of all pairs, also where a block is hot and its texts belong to several groups."""
    rng = random.Random(6)
    texts = near_texts(rng)
    # Texts of one template, half of it their own: they share blocks and are not alike; each has a copy.
    template = [f"t{k}" for k in range(120)]
    for k in range(40):
        own = " ".join([*template, *[f"own{k}x{i}" for i in range(40)]])
        texts += [own, own + " end"]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_groups(documents(spark, texts), pair_limit=pair_limit).collect()}
    texts = [t or "" for t in texts]
    want = brute.similar(dict(enumerate(texts)))
    assert all(want[i] == want[got[i]] for i in got)
    sets = [set(brute.shingles(t, 5)) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 100 and np.mean([got[i] == got[j] for i, j in pairs]) > 0.98


def test_keep_one_of_an_id_with_two_texts(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 70)
    docs = documents(spark, [a, b, a, b, b], ids=[1, 2, 2, 2, 3])
    assert sorted((r["doc_id"], r["text"]) for r in simhash_dedup.keep_one(docs).collect()) == sorted([(1, a), (2, b), (2, b)])


def test_wide_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 20, 400):
        text = prose(rng, n) if n else ""
        own = simhash_dedup.wide_simhash(simhash_dedup.shingle_hashes(text.encode(), 5), 3)
        assert sum(int(x) % 2**64 << 64 * k for k, x in enumerate(own.tolist())) == brute.wide_simhash(text, 5, 3)


def test_risk_and_prior():
    """Slopes are those of the written-out risk; the prior of a known mixture is found."""
    from attrilens.llm import pu_classifier as pu

    rng = np.random.default_rng(1)

    def risk(g, n, prior):
        p, u = g[:n], g[n:]
        softplus = lambda x: np.log1p(np.exp(x))
        return prior * softplus(-p).mean(), softplus(u).mean() - prior * softplus(p).mean()

    for prior, shift in ((0.3, 1.0), (0.5, 0.0), (0.9, -4.0)):
        g = np.concatenate([rng.normal(1, 1, 7), rng.normal(shift, 1, 9)])
        assert np.allclose(pu.risk(g[:7], g[7:], prior), risk(g, 7, prior))
        held = risk(g, 7, prior)[1] >= 0
        target = lambda g: sum(risk(g, 7, prior)) if held else -risk(g, 7, prior)[1]  # noqa: B023, E731
        numeric = [(target(g + 1e-6 * e) - target(g - 1e-6 * e)) / 2e-6 for e in np.eye(16)]
        assert np.allclose(pu.slopes(g[:7], g[7:], prior), numeric, atol=1e-6)
    assert {risk(np.concatenate([np.full(7, 1.0), np.full(9, s)]), 7, 0.9)[1] >= 0 for s in (1.0, -4.0)} == {True, False}
    x = lambda n, m: np.column_stack([rng.normal(m, 1, n), rng.normal(-m, 1, n)])
    for share in (0.2, 0.6):
        unlabelled = np.concatenate([x(int(4000 * share), 1.5), x(4000 - int(4000 * share), -1.5)])
        prior = pu.fit_prior(x(2000, 1.5), unlabelled)
        assert abs(prior - share) < 0.08
        net = pu.fit(x(2000, 1.5), unlabelled, prior)
        assert (net.scores(x(1000, 1.5)) > 0.5).mean() > 0.9 and (net.scores(x(1000, -1.5)) < 0.5).mean() > 0.9


def test_sample_is_bounded(spark, monkeypatch):
    """Rows far beyond the limit are neither measured nor sent, copies count once, and the sample has its size."""
    from attrilens.llm import common, pu_classifier

    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert 500 <= common.hashed_below(rows, 500, "doc_id", "text").count() < 900
    assert len(pu_classifier._sample(rows, 500)) == 500 and len(pu_classifier._sample(rows.limit(40).union(rows.limit(40)), 500)) == 40


def test_classifier(spark):
    got = run(spark, "/root/testdata/sf0.01", "op10_quality_classifier")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[i]["score"], q) for i, q in labels.items() if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == bool(q) for s, q in held]) > 0.93
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
