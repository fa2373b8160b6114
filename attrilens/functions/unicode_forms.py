"""X4 in the JVM: compatibility decomposition without marks, lower case and word characters, from tables of Unicode data.

Decomposition goes code point by code point, as marks are dropped anyway and
their order does not matter. Code points that become one other, or nothing, go
through one ``translate``; those that become several are looked up in an array
by their number, in the texts that hold any.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Never part of a table's entries.
_SEPARATOR = "\x00"


def plain(text: str) -> str:
    """The same by Python: words in match form."""
    flat = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)).lower()
    return " ".join("".join(ch if ch.isalnum() or ch == "_" else " " for ch in flat).split())


def _ranges(codes: list[int], gap: int = 1) -> list[tuple[int, int]]:
    """First and last of the runs of sorted numbers, runs that lie gap apart or less as one."""
    out: list[tuple[int, int]] = []
    for c in codes:
        if out and c - out[-1][1] <= gap:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _class(codes: list[int]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _ranges(codes))


@functools.cache
def _tables():
    """(from, to) of single code points, {code point: string} of the others, (upper, lower), and the class of word characters beyond ASCII."""
    single, gone, several, upper, words = {}, [], {}, {}, []
    for cp in range(128, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        to = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if not to:
            gone.append(ch)
        elif len(to) > 1:
            several[cp] = to
        elif to != ch:
            single[ch] = to
        elif len(ch.lower()) == 1 and ch.lower() != ch and ch != "Σ":
            upper[ch] = ch.lower()
        if ch.isalnum():
            words.append(cp)
    upper |= {chr(c): chr(c + 32) for c in range(65, 91)}
    return ("".join([*single, *gone]), "".join(single.values())), several, ("".join(upper), "".join(upper.values())), _class(words)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value written once in the plan however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


# Letters of Korean syllables in the order of their numbers; a syllable has one of each, the last may be none.
_LEADS, _VOWELS, _TAILS = ("".join(chr(a + k) for k in range(n)) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _in_full(c: Column, several: dict[int, str]) -> Column:
    """Code points that become several, in their full form; Korean syllables by their number."""
    others = {cp: to for cp, to in several.items() if not 0xAC00 <= cp <= 0xD7A3}
    keys, table = F.lit("".join(map(chr, others))), F.split(F.lit(_SEPARATOR.join(others.values())), _SEPARATOR)
    letter = lambda of, k: F.substring(F.lit(of), (k + 1).cast("int"), F.lit(1))

    def one(ch: Column) -> Column:
        k = F.ascii(ch) - 0xAC00
        tail = F.when(k % 28 > 0, letter(_TAILS, k % 28 - 1)).otherwise("")
        syllable = F.concat(letter(_LEADS, F.floor(k / 588)), letter(_VOWELS, F.floor(k % 588 / 28)), tail)
        return F.when(k.between(0, 11171), syllable).otherwise(F.when(k > 128 - 0xAC00, F.coalesce(F.get(table, F.nullif(F.instr(keys, ch), F.lit(0)) - 1), ch)).otherwise(ch))

    return F.array_join(F.transform(F.split(c, ""), one), "")


def match_words(c: Column) -> Column:
    """Words in match form, joined by one space: accents and other marks dropped, compatible forms plain, lower case."""
    (old, new), several, (upper, lower), words = _tables()
    flat = let(F.translate(c, old, new), lambda x: F.when(x.rlike(f"[[^\\x00-\\x7F]&&[{_class(sorted(several))}]]"), _in_full(x, several)).otherwise(x))
    # The lower case of one letter depends on its place.
    low = let(F.translate(flat, upper, lower), lambda x: F.when(F.contains(x, F.lit("Σ")), F.lower(x)).otherwise(x))
    # Java tests a long class range by range, so it is asked only about characters that short classes leave open.
    other = rf"[[\x00-\x7F&&[^a-z0-9_]][\p{{P}}\p{{Z}}\p{{S}}&&[^_]][[^\x00-\x7F\p{{L}}\p{{N}}]&&[^{words}]]]+"
    return F.trim(F.regexp_replace(low, other, " "))
