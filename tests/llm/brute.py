"""Plain versions of the operators, for small tables."""

import math
import re
import unicodedata
from collections import Counter

import xxhash

from attrilens.llm import fingerprints, quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text))


def lines(texts, min_words):
    """Kept lines of each text: earliest of equal lines and of lines within one word edit, pair by pair."""
    seen, out = [], []
    for text in texts:
        kept = []
        for line in text.split("\n"):
            form = re.sub(r"[ \t\r\x0b\x0c]+", " ", line.lower()).strip(" ")
            if not form:
                kept.append(line)
                continue
            w = form.split(" ")
            if not any(form == f or (len(w) >= min_words and len(v) >= min_words and one_edit(w, v)) for f, v in seen):
                kept.append(line)
            seen.append((form, w))
        out.append("\n".join(kept))
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j >= max(len(a), len(b)) - 1


def digest(data):
    """Length code and quartile of each bucket, triplet by triplet in whole numbers."""
    counts = [0] * fingerprints.BUCKETS
    for k, (i, j) in enumerate(fingerprints.TRIPLETS):
        for at in range(len(data) - j):
            h = (data[at] * 2654435761 + data[at + i] * 2246822507 + data[at + j] * 3266489909 + k * 668265263) % 2**32
            h ^= h >> 15
            h = h * 739982445 % 2**32
            h ^= h >> 12
            counts[h % fingerprints.BUCKETS] += 1
    order = sorted(counts)
    n = len(counts)
    quartiles = [order[n // 4 - 1], order[n // 2 - 1], order[3 * n // 4 - 1]]
    steps = [sum(c > q for q in quartiles) for c in counts]
    length = min(255, int(math.log1p(len(data)) / math.log(fingerprints.LENGTH_BASE)))
    return length, steps


def digest_hex(data):
    length, steps = digest(data)
    return bytes([length, *(sum(s << 2 * k for k, s in enumerate(steps[at : at + 4])) for at in range(0, len(steps), 4))]).hex()


def likeness(a, b):
    """Of two texts: mean step of their buckets against that of independent ones, less a penalty for length."""
    if digest_hex(a) == digest_hex(b):
        return 1.0
    (la, ca), (lb, cb) = digest(a), digest(b)
    n = len(ca)
    step = sum(abs(x - y) for x, y in zip(ca, cb)) / n
    share = [[c.count(q) / n for q in range(4)] for c in (ca, cb)]
    chance = sum(share[0][x] * share[1][y] * abs(x - y) for x in range(4) for y in range(4))
    same = max(0.0, 1 - step / chance) if chance else 1.0
    return same * (1 - fingerprints.LENGTH_WEIGHT * min(abs(la - lb), fingerprints.LENGTH_CAP) / fingerprints.LENGTH_CAP)


def spans(text):
    out = []
    for number, rule in enumerate(secret_scan.RULES):
        regex = r"[0-9a-f]+" if rule.kind == "hex" else rule.regex
        for m in re.finditer(regex, text, re.ASCII):
            if rule.kind == "hex" and len(m.group()) < 16 or len(m.group(rule.group)) < rule.least:
                continue
            out.append((m.start(), number, m.end(), rule.kind))
    return sorted(out)


def redacted(text):
    runs, out, last = [], "", 0
    for start, _, end, _ in spans(text):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    for start, end in runs:
        out += text[last:start] + secret_scan.REDACTED
        last = end
    return out + text[last:]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    found = WORD.findall(text)
    seen = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    inside = {j for i in range(len(found) - 7) if seen[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    rows = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(inside)


def entropy(ids):
    n = len(ids)
    return -sum(c / n * math.log2(c / n) for c in Counter(ids).values())


def measures(text, pieces, tokens, is_byte):
    """Fertility and entropy in both vocabularies, and the share of byte pieces."""
    return len(text) / len(pieces), len(text) / len(tokens), entropy(pieces), entropy(tokens), sum(is_byte[i] for i in pieces) / len(pieces)


def group(text, lang):
    """Language, else the script of most letters."""
    if lang is not None:
        return lang
    found = Counter(unicodedata.name(c, "NONE").split(" ")[0] for c in text if c.isalpha())
    return min(found, key=lambda k: (-found[k], k)) if found else "NONE"


def verdicts(rows):
    """Whether each (group, half octave, measures) stands inside its bands, from all of them."""
    q = quality_rules
    names = q.MEASURES

    def at(name, v):
        return math.floor(v * q.SHARE_STEPS) if name == "byte_share" else math.floor(v * q.STEPS) if "entropy" in name else math.floor(math.log2(v) * q.STEPS)

    def middle(name, k):
        return (k + 0.5) / q.SHARE_STEPS if name == "byte_share" else (k + 0.5) / q.STEPS if "entropy" in name else 2 ** ((k + 0.5) / q.STEPS)

    own = {}
    for key in {(g, h) for g, h, _ in rows}:
        part = [m for g, h, m in rows if (g, h) == key]
        band = []
        for k, name in enumerate(names):
            bins = sorted(at(name, m[k]) for m in part)
            low, high = (bins[max(0, math.ceil(s * len(bins)) - 1)] for s in (0.5, 0.75))
            band.append((middle(name, low), middle(name, high) - middle(name, low)))
        own[key] = len(part), band
    total = sum(n for n, _ in own.values())
    every = [sum(n * b[k][1] for n, b in own.values()) / total for k in range(len(names))]
    out = []
    for g, h, m in rows:
        near = [(n if o == h else min(n, q.PRIOR_SIZE) * q.DECAY ** abs(o - h), b) for (x, o), (n, b) in own.items() if x == g]
        w = sum(x for x, _ in near)
        z = {}
        for k, name in enumerate(names):
            mid = sum(x * b[k][0] for x, b in near) / w
            dev = (sum(x * b[k][1] for x, b in near) + q.PRIOR_SIZE * every[k]) / (w + q.PRIOR_SIZE)
            z[name] = m[k] - mid if name == "byte_share" else (m[k] - mid) / (1.4826 * dev) if dev else 0.0
        wide = 1 + q.WIDER * q.PRIOR_SIZE / (w + q.PRIOR_SIZE)
        low, high, told = min(z["fertility"], z["byte_fertility"]), max(z["fertility"], z["byte_fertility"]), min(z["entropy"], z["byte_entropy"])
        out.append(not (low + told < q.JOINT_LOW * wide or low < q.FERTILITY_LOW * wide or high > q.FERTILITY_HIGH * wide or z["byte_share"] > q.BYTE_EXCESS))
    return out


def shingles(text, width):
    w = words(text)
    return [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def simhash(text, width=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def wide_simhash(text, width, longs):
    """Bits of all numbers of a fingerprint, one after the other."""
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    out, mask = 0, 2**64 - 1
    for k in range(longs):
        drawn = []
        for x in h:
            x = x + (k + 1) * 0x9E3779B97F4A7C15 & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            drawn.append(x ^ x >> 31)
        out |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in drawn) > len(drawn)) << 64 * k
    return out


def components(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def alike(a, b, similarity=0.8, width=5):
    """Equal word sequences, or sets of shingles of at least this Jaccard similarity."""
    if words(a) == words(b):
        return True
    x, y = set(shingles(a, width)), set(shingles(b, width))
    return len(x & y) >= similarity * len(x | y) > 0


def similar(texts, similarity=0.8):
    """Component of each text id by all pairs."""
    ids = sorted(texts)
    return components([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if alike(texts[a], texts[b], similarity)], ids)