"""Every operator and stage on nulls, empties, repeats, long texts, empty tables and clashing extra columns."""

import hashlib
import importlib
import math
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attrilens.llm import bpe, fingerprints, html_extract, line_dedup, packing, pu_classifier, quality_rules, secret_scan, simhash_dedup, suffix_tree
from attrilens.llm.queries import ORACLE_SQL, QUERIES

from . import brute
from .helpers import documents, edge_texts, very_long_texts


def _pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "source", F.col("n_chars").alias("n_chars"))


def _classify(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return pu_classifier.score(docs, *pu_classifier.train(docs, labels, max_positive=50, max_unlabelled=50))


NEXT = "doc_id long, n long, s string, a string, b string, e double, f double"
OPERATORS = {
    "line dedup": line_dedup.dedup_lines,
    "line stage": lambda d: corpus_pipeline.lines(d.sparkSession, d, ""),
    "fingerprints": fingerprints.with_fingerprint,
    "next": lambda d: fingerprints.with_next(d, fingerprints._edited, NEXT),
    "packing": packing.pack_documents,
    "packing stage": lambda d: corpus_pipeline.packed(d.sparkSession, d, ""),
    "secrets": secret_scan.scan,
    "redact": secret_scan.redact,
    "secret stage": lambda d: corpus_pipeline.secrets(d.sparkSession, d, ""),
    "bpe": bpe.digest_documents,
    "bpe ids": bpe.encode_documents,
    "html": lambda d: html_extract.extract(_pages(d)),
    "quality": quality_rules.judged,
    "quality stage": lambda d: corpus_pipeline.quality(d.sparkSession, d, ""),
    "suffix tree": suffix_tree.score_documents,
    "simhash": simhash_dedup.near_groups,
    "similar groups": simhash_dedup.similar_groups,
    "near-duplicate stage": lambda d: corpus_pipeline.near_duplicates(d.sparkSession, d, ""),
    "classifier": _classify,
}
#: Stages and filters give whole rows back.
WHOLE = ("line dedup", "line stage", "redact", "secret stage", "quality stage", "near-duplicate stage")

_TEXTS = edge_texts()
_IDS = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13]
#: id and text of every row; row 5 is there twice, id 13 has two texts, rows 8 and 9 are copies.
ROWS = [*zip(_IDS, _TEXTS), (5, _TEXTS[5])]
LONG_ROWS = [*ROWS[:9], *enumerate(very_long_texts(), 100)]


def table(spark, rows):
    return documents(spark, [t for _, t in rows], extra=True, ids=[i for i, _ in rows])


def by_row(got, rows, value):
    """(id, value) of all rows, sorted."""
    return sorted(((r["doc_id"], value(r)) for r in got), key=repr), sorted(rows, key=repr)


def check_packing(got, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut_points(len(ids), 2048)):
            want.append((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=repr) == sorted(want, key=repr)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 2


def check_lines(got, rows, empty_stay=True):
    # Rows that repeat an id and text are one document; rows of one id come by text hash, but share no line here.
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, repr(r[1])))
    kept = dict(zip(order, brute.lines([t or "" for _, t in order], line_dedup.MIN_WORDS)))
    want = [(i, None if t is None else kept[i, t]) for i, t in rows]
    if not empty_stay:
        want = [(i, t) for i, t in want if t is not None and re.search(r"\S", t)]
    have, want = by_row(got, want, lambda r: r["text"])
    assert have == want


def check_tokens(got, rows, of):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, (ids, tok.decode(ids, skip_special_tokens=False))))
    have, want = by_row(got, [(i, of(*x)) for i, x in want], lambda r: tuple(r)[1:])
    assert have == want


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check_next(got, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        want.append((i, (len(t), sha(t[: len(t) - n] + after[:n]), fingerprints.digest(t.encode()))))
    have, want = by_row(got, want, lambda r: (r["n"], r["s"], r["a"]))
    assert have == want


def check_scores(got, rows):
    texts = [t or "" for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    counts = Counter(w for t, used in zip(texts, train) if used for w in [*brute.words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _), t, used in zip(rows, texts, train):
        c = [counts[w] for w in [*brute.words(t), None]]
        want.append((i, (not used, len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 4))))
    have, want = by_row(got, want, lambda r: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)))
    assert have == want and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def check_near(got, rows, groups):
    """groups: an equal value for texts that link."""
    least = {}
    for i, t in rows:
        g = groups[t or ""]
        if i is not None:
            least[g] = min(i, least.get(g, i))
    have, want = by_row(got, [(i, least.get(groups[t or ""])) for i, t in rows], lambda r: r["component_id"])
    assert have == want
    return least


def linked(rows, close):
    texts = sorted({t or "" for _, t in rows})
    root = brute.components([(a, b) for a in range(len(texts)) for b in range(a) if close(texts[a], texts[b])], range(len(texts)))
    return {t: root[k] for k, t in enumerate(texts)}


def check(name, got, rows, docs):
    if name in WHOLE:
        assert got == [] or got[0].asDict().keys() == {c: 0 for c in docs.columns}.keys()
    if name == "line dedup":
        check_lines(got, rows)
    elif name == "line stage":
        check_lines(got, rows, False)
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    elif name in ("packing", "packing stage"):
        check_packing(got, rows)
    elif name == "fingerprints":
        short = [(i, t) for i, t in rows if len(t or "") < 20_000]
        have, want = by_row([r for r in got if r["doc_id"] is None or r["doc_id"] < 100], [(i, brute.digest_hex((t or "").encode())) for i, t in short if i is None or i < 100], lambda r: r["fingerprint"])
        assert have == want if len(short) == len(rows) else len(got) == len(rows)
    elif name == "next":
        check_next(got, rows)
    elif name == "secrets":
        have, want = by_row(got, [(i, brute.spans(t or "")) for i, t in rows], lambda r: [tuple(s) for s in r["spans"]])
        assert have == want
    elif name in ("redact", "secret stage"):
        have, want = by_row(got, [(i, None if t is None else brute.redacted(t)) for i, t in rows], lambda r: r["text"])
        assert have == want
    elif name == "bpe":
        check_tokens(got, rows, lambda ids, text: (len(ids), sha(" ".join(map(str, ids))), sha(text)))
    elif name == "bpe ids":
        check_tokens(got, rows, lambda ids, text: (ids, text))
    elif name == "html":
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
        assert {r["text"] for r in got if r["page_id"] in (None, 1, 2)} == {""}
        assert {r["text"] for r in got if r["page_id"] == 8} == {" ".join(_TEXTS[8].split())}
    elif name == "quality":
        have, want = by_row(got, [(i, brute.quality(t or "")) for i, t in rows], lambda r: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
        assert have == want and all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    elif name == "quality stage":
        kept = {(r["doc_id"], r["text_key"]) for r in quality_rules.judged(docs).where("kept").collect()}
        want = docs.withColumn("_k", F.xxhash64("text")).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r["doc_id"], r["text"]) for r in want if (r["doc_id"], r["_k"]) in kept) and len(got) >= 2
    elif name == "suffix tree":
        check_scores(got, rows)
    elif name == "simhash":
        fps = {t or "": brute.simhash(t or "") for _, t in rows}
        check_near(got, rows, linked(rows, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2))
    elif name in ("similar groups", "near-duplicate stage"):
        groups = linked(rows, brute.alike)
        if name == "similar groups":
            check_near(got, rows, groups)
            return
        least = {}
        for i, t in rows:
            if i is not None:
                least[groups[t or ""]] = min(i, least.get(groups[t or ""], i))
        have, want = by_row(got, [(i, t) for i, t in rows if groups[t or ""] not in least or i == least[groups[t or ""]]], lambda r: r["text"])
        assert have == want
    elif name == "classifier":
        score = {t: s for (_, t), s in zip(sorted(rows, key=repr), [None] * len(rows))}
        for r in got:
            assert 0 <= r["score"] <= 1
        same = {}
        for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
            if r["doc_id"] != 13:
                assert same.setdefault(t or "", r["score"]) == r["score"]
        assert len(got) == len(rows) and score.keys() >= {None, ""}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    """Nulls, empties, blanks, copies, repeated rows and ids, odd characters, clashing extra columns: the results by value."""
    docs = table(spark, ROWS)
    check(name, OPERATORS[name](docs).collect(), ROWS, docs)


@pytest.mark.parametrize("name", [k for k in OPERATORS if k not in ("simhash", "similar groups", "near-duplicate stage", "classifier", "html", "quality stage")])
def test_very_long_texts(spark, name):
    """The same with texts of megabytes."""
    docs = table(spark, LONG_ROWS)
    check(name, OPERATORS[name](docs).collect(), LONG_ROWS, docs)


@pytest.mark.parametrize("name", ["simhash", "similar groups", "near-duplicate stage", "classifier", "html", "quality stage"])
def test_very_long_texts_run(spark, name):
    got = OPERATORS[name](table(spark, LONG_ROWS)).collect()
    assert len(got) == len(LONG_ROWS) or name.endswith("stage") and 0 < len(got) < len(LONG_ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs = documents(spark, ["x"]).where("doc_id < 0")
    assert OPERATORS[name](docs).count() == 0


def test_names():
    assert [k for n in range(1, 11) for k in QUERIES if k.startswith(f"op{n}_")] == sorted(QUERIES, key=lambda k: int(k[2:].split("_")[0]))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("gone", ["llm", "pipeline", "both"])
def test_entry_without(tmp_path, gone):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "attrilens", tmp_path / "attrilens", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if gone != "pipeline" else [])))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if gone == "llm":
        pass  # the pipeline goes with its operators
    elif gone != "both" and gone != "pipeline":
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, ops, pipe = out.stdout.split()
    assert int(n) > 50 and ops == str(gone == "pipeline") and pipe == "False"


def test_modules_do_not_leak():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(importlib.import_module("attrilens").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M), p
