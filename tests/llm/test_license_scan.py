"""Licence scans: templates against regular expressions, wording with and without its optional parts, edge rows."""

import random
import re

import pytest

from attrilens.llm import license_scan
from attrilens.llm.license_scan import TEMPLATES, Matcher, Template, scan_text

from .helpers import documents, edge_texts, prose, very_long_texts


def drawn(markup, rng):
    """A text of a template, with some of its optional parts and some words in its replaceable ones."""
    while "[[" in markup:
        markup = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: m[1] if rng.random() < 0.5 else "", markup)
    markup = re.sub(r"\{\{(\d+)-(\d+)\}\}", lambda m: " ".join(rng.choices(["acme", "the", "authors", "1", "license"], k=rng.randint(int(m[1]), int(m[2])))), markup)
    return " ".join(markup.split())


def plain(text):
    """(words, base places, base labels, labels, mandatory words) by regular expressions over the whole text."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = "".join(" " + w for w in words) + " "
    places, labels = [], {}
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        if at:
            labels[label] = max(labels.get(label, 0), len(p))
    base = set(labels)
    for label, markup in TEMPLATES:
        if re.search(license_scan._regex(markup), joined):
            labels[label] = max(labels.get(label, 0), Template(label, markup).n)
    return len(words), sorted(places), base, set(labels), max(labels.values(), default=0)


def found(text, matcher):
    n, got = scan_text(text.encode(), matcher)
    base = [x for x in got if x[4]]
    return n, sorted(x[1] for x in base), {x[0] for x in base}, {x[0] for x in got}, max([x[3] for x in got], default=0)


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_template_wording(k):
    rng, matcher = random.Random(k), Matcher(TEMPLATES)
    label, markup = TEMPLATES[k]
    for _ in range(8):
        text = drawn(markup, rng)
        shown = f"{prose(rng, 5)}. " + re.sub(r"(\w+) ", lambda m: m[1].title() + rng.choice([" ", ", ", "\n  ", " (", ".\t"]), text) + " " + prose(rng, 4)
        assert label in found(shown, matcher)[3]
        assert found(shown, matcher) == plain(shown)
        words = text.split()
        at = rng.randrange(len(words))
        damaged = " ".join(words[:at] + [rng.choice(["zzz", words[at] + "x"])] + words[at + 1 :])
        assert found(damaged, matcher) == plain(damaged)
        cut = " ".join(words[: rng.randrange(len(words))])
        assert found(cut, matcher) == plain(cut)


def test_random_word_orders():
    rng, matcher = random.Random(7), Matcher(TEMPLATES)
    words = "licensed under the a apache license version 2 0 gnu general public 3 mit released terms of cc by nc sa 4 all rights reserved this work is".split()
    for _ in range(400):
        text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        assert found(text, matcher) == plain(text)


def test_sets_of_states_are_bounded(monkeypatch):
    monkeypatch.setattr(Matcher, "MOST_SETS", 40)
    rng, matcher = random.Random(3), Matcher(TEMPLATES)
    for _ in range(60):
        text = " ".join(drawn(rng.choice(TEMPLATES)[1], rng) for _ in range(2))
        assert found(text, matcher) == plain(text)


def test_words_are_those_of_the_contract():
    text = "".join(map(chr, range(0x250))) + " 日本 \U0001f600x"
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert scan_text(text.encode(), Matcher(TEMPLATES))[0] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def test_edge_rows(spark):
    texts = [*edge_texts(), "CC BY cc-by CC_BY ccby cc by", "license " * 100_000, "licensed under " * 100_000 + "the MIT license", *very_long_texts()]
    docs = documents(spark, texts, extra=True)
    rows = license_scan.scan(docs.union(docs.where("doc_id = 5"))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = plain(texts[r["doc_id"]] or "")
        base = [x for x in r["found"] if x["base"]]
        assert (r["n_words"], sorted(x["first"] for x in base), {x["label"] for x in r["found"]}) == (want[0], want[1], want[3])
    assert license_scan.scan(docs.limit(0)).count() == 0
