"""Text scalars: cleaning, names, prompts and keys, as column expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_forms

# Ranges of letters that count as Latin, and of Arabic characters (Java regex classes).
LATIN = r" -~ -ÿĀ-ſƀ-ɏḀ-ỿ"
ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷽ﹰ-﻿"

# Last tokens that never count as a last name.
LAST_NAME_STOPWORDS = (
    "poet", "writer", "author", "artist", "musician", "singer", "rapper", "actor", "actress", "producer", "director",
    "professor", "doctor", "dr", "mr", "mrs", "ms", "miss", "sir", "lord", "lady", "jr", "sr", "love", "truth",
    "still", "wisdom", "better", "bond", "legacy", "foster", "pride", "battle", "early", "silver", "virtue", "bonds",
    "innocent", "seven", "cope", "fields", "quick", "page", "flash", "rather", "hope", "gates", "sign", "good",
    "black", "young", "french", "great", "deep", "books", "holiday", "prior", "chance", "block", "white", "rock",
)

# Phrases that mark an answer without a name.
NO_ANSWER = [
    "don't know", "do not know", "cannot identify", "can't identify",
    "unable to determine", "not enough information", "insufficient information",
    "cannot say", "can't say", "unknown author", "anonymous",
]

# Accepted short forms of names, and author fields that are no people.
ALIASES = {
    "martin luther king jr": ["dr king", "mlk", "mlk jr", "king jr"],
    "malcolm x": ["malcolm little"],
    "w e b dubois": ["web dubois", "w e b du bois"],
    "j r r tolkien": ["jrr tolkien"],
    "t i": ["ti", "t.i."],
}
NON_PERSON_AUTHORS = ["the sound of serendipity"]

# Prompts of the direct runs and of the runs with retrieved context.
PROMPTS = {
    "direct": 'Please identify the author of the following quote. Be concise and answer in maximum 1 sentence.\n"{passage}"',
    "indirect": 'Briefly summarize the context in which the following quote was written. Be concise and answer in maximum 1 sentence.\n"{passage}"',
    "indirect_overt": 'Briefly summarize the context in which the following quote was written, mentioning the author if relevant. Be concise and answer in maximum 1 sentence.\n"{passage}"',
}
CONTEXT_PROMPTS = {
    "direct": 'Please identify the author of the following quote.\nQuote:\n"{passage}"\n\nRetrieved examples:\n{context}',
    "indirect": 'Briefly summarize the context in which the following quote was written.\nQuote:\n"{passage}"\n\nRetrieved examples:\n{context}',
    "indirect_overt": "Briefly summarize the context in which the following quote was written and mention the author's name if relevant.\nQuote:\n\"{passage}\"\n\nRetrieved examples:\n{context}",
}
NO_NEIGHBOURS = "No strong embedding-similarity neighbors found in retrieval set."
EDGE_SPACE = r"^\s+|\s+$"
#: Word characters as Unicode letters and digits; ASCII text gives what \w gives everywhere.
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def cell(c: Column) -> Column:
    """Null as empty, else stripped text."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Stripped, lower case, white space as one space; null as empty."""
    return F.regexp_replace(F.lower(cell(c)), r"\s+", " ")


def count_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def is_latinish(c: Column) -> Column:
    """No Arabic character, no letter outside the Latin ranges."""
    return ~c.rlike(f"[{ARABIC}]") & ~c.rlike(rf"[\p{{L}}&&[^{LATIN}]]")


def _tail_size(tokens: Column) -> Column:
    """Tokens at the end that have lower-case letters and no upper-case one."""
    plain = F.transform(F.reverse(tokens), lambda t: (t == F.lower(t)) & t.rlike("[a-z]") & ~t.rlike("[A-Z]"))
    other = F.array_position(plain, False)
    return F.when(other == 0, F.size(tokens)).otherwise(other - 1).cast("int")


def clean_author(raw: Column) -> Column:
    """Struct of the cleaned name and of what was split off it (sorted, distinct, joined by '; ')."""
    # Each step is a column of one lambda, as the steps name what is before them more than once.
    let = unicode_forms.let
    dash = r"\s+[-–—]\s+"

    def bare(name: Column) -> Column:
        name = F.regexp_replace(name, r"^[\"'` ]+|[\"'` ]+$", "")
        return F.split(F.regexp_replace(name, r"^[-–—~]+\s*", ""), r"(?i)\s+(?:aka|a\.k\.a\.)\s+")

    def bracketed(parts: Column) -> Column:
        also = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), strip)
        return let(F.when(F.size(parts) > 1, strip(parts[0])).otherwise(parts[0]), lambda name: F.struct(name.alias("name"), F.concat(also, F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)")), strip)).alias("alt")))

    def sided(x: Column) -> Column:
        name = x["name"]
        out = F.when(name.rlike(r"\([^)]*\)"), strip(F.regexp_replace(name, r"\s*\([^)]*\)", ""))).otherwise(name)
        return F.struct(F.split(out, dash, 2).alias("sides"), out.alias("bare"), x["alt"].alias("alt"))

    def cut(x: Column) -> Column:
        two = F.size(x["sides"]) > 1
        left = F.when(two, strip(x["sides"][0])).otherwise(x["bare"])
        right = F.when(two, F.array(strip(F.get(x["sides"], F.lit(1))))).otherwise(F.array().cast("array<string>"))
        return F.struct(left.alias("left"), F.concat(x["alt"], right).alias("alt"))

    def tailed(x: Column) -> Column:
        tokens = F.filter(F.split(x["left"], r"\s+"), lambda t: t != "")
        return let(tokens, lambda t: let(_tail_size(t), lambda tail: F.when(tail >= 3, F.array_join(F.slice(t, F.lit(1), F.greatest(F.size(t) - tail, F.lit(0))), " ")).otherwise(x["left"])))

    def final(x: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(tailed(x), r"\s+", " "), r"^[ ,;]+|[ ,;]+$", "")
        alt = F.array_join(F.array_sort(F.array_distinct(F.filter(x["alt"], lambda a: a != ""))), "; ")
        return F.struct(name.alias("name"), alt.alias("alt"))

    return let(let(let(let(bare(cell(raw)), bracketed), sided), cut), final)


def canonicalize_author(c: Column) -> Column:
    """Drop leading marks, AKA parts, bracketed and quoted spans and dash titles."""
    # The patterns, and the order of the steps.
    name = F.regexp_replace(c, r"^[\s\-–—•]+", "")
    name = F.split(name, r"(?i)\baka\b|\ba\.k\.a\.\b")[0]
    for span in (r"\([^)]*\)", r"«[^»]*»", r'"[^"]*"', r"'[^']*'"):
        name = F.regexp_replace(name, span, "")
    name = F.split(name, r"\s[-–—]\s")[0]
    name = strip(F.regexp_replace(name, r"\s+", " "))
    return strip(F.regexp_replace(name, r"[-–—]\s*$", ""))


def ascii_words(c: Column) -> Column:
    """X4 for ASCII text: equal to match_words there."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "))


def normalize_for_match(c: Column) -> Column:
    """ASCII text the short way, other text through tables of Unicode data; all in the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), ascii_words(c)).otherwise(unicode_forms.match_words(c))


def last_name(author: Column, normalise=normalize_for_match) -> Column:
    """Last token in match form; null for one token, under four letters, or a stopword."""
    tokens = F.filter(F.split(author, r"\s+"), lambda t: t != "")
    last = unicode_forms.let(normalise(F.try_element_at(tokens, F.lit(-1))), lambda x: F.when((F.length(x) >= 4) & ~x.isin(*LAST_NAME_STOPWORDS), x))
    return F.when(F.size(tokens) > 1, last)


# Fixed value: a run of capitalised words or initials.
NAME_RUN = r"\b([A-Z][a-z]+|[A-Z]\.)(?:[-'][A-Z][a-z]+)?(?:\s+([A-Z][a-z]+|[A-Z]\.)(?:[-'][A-Z][a-z]+)?)+\b"


# The same with ASCII borders and white space spelled out; Java's own \b counts letters of all scripts.
_ASCII_BORDER = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_NAME_RUN_JAVA = NAME_RUN.replace(r"\b", _ASCII_BORDER).replace(r"\s", r"[\t\n\f\r ]")


def mentions_any_name(c: Column) -> Column:
    """Two capitalised words or initials in a row."""
    return F.coalesce(c.rlike(_NAME_RUN_JAVA), F.lit(False))


def no_answer(c: Column) -> Column:
    """Empty, or a phrase that declines."""
    lower = F.lower(c)
    hit = lower.contains(NO_ANSWER[0])
    for phrase in NO_ANSWER[1:]:
        hit = hit | lower.contains(phrase)
    return F.coalesce((c == "") | hit, F.lit(True))


def build_aliases(author: Column, alt: Column | None = None) -> Column:
    """Full name, last name, initial forms and the alternate name, in order, distinct."""
    full = cell(author)
    tokens = F.filter(F.split(full, r"\s+"), lambda t: t != "")
    last, initial = F.try_element_at(tokens, F.lit(-1)), F.substring(full, 1, 1)
    forms = F.when(F.size(tokens) >= 2, F.array(full, last, F.concat(initial, F.lit(" "), last), F.concat(initial, F.lit(". "), last))).otherwise(F.array(full))
    if alt is not None:
        forms = F.concat(forms, F.array(cell(alt)))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def contains_alias(text: Column, aliases: Column) -> Column:
    """Any alias as a substring, letter case apart."""
    lower = F.lower(text)
    return F.coalesce(F.exists(aliases, lambda a: F.contains(lower, F.lower(a))), F.lit(False))


def decode_choice(letter: Column, options: Column) -> Column:
    """The option of a letter A, B, ...; an option named in full stands for itself."""
    code = F.upper(cell(letter))
    by_letter = F.when(F.length(code) == 1, F.get(options, F.ascii(code) - 65))
    literal = F.get(F.filter(options, lambda o: F.lower(o) == F.lower(cell(letter))), F.lit(0))
    return F.coalesce(by_letter, literal)


def render(template: str, **fields: Column) -> Column:
    """A template with its fields filled in by concatenation, so filled text is never filled again."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{%s}" % k), k) for k in fields if "{%s}" % k in rest) if any("{%s}" % k in rest for k in fields) else None
        if at is None:
            parts.append(F.lit(rest))
            break
        if at[0]:
            parts.append(F.lit(rest[: at[0]]))
        parts.append(F.coalesce(fields[at[1]], F.lit("")))
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def render_context(items: Column, labelled: bool = True) -> Column:
    """X11: numbered neighbours (author, score, quote); a fixed text if there are none."""

    def line(x, i):
        head = F.concat((i + 1).cast("string"), F.lit(". "))
        who = F.concat(F.lit("author: "), x["author"], F.lit(" | ")) if labelled else F.lit("")
        return F.concat(head, who, F.lit("similarity: "), F.format_string("%.4f", x["score"]), F.lit(' | quote: "'), x["quote"], F.lit('"'))

    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(NO_NEIGHBOURS)).otherwise(F.array_join(F.transform(items, line), "\n"))


def request_id(*parts: Column) -> Column:
    """X12"""
    return F.concat_ws("__", *[p.cast("string") for p in parts])


def exact_keyword(author: Column, quote: Column) -> Column:
    """Author and quote each in double quotes, their own quotes removed."""
    bare = lambda c: F.replace(cell(c), F.lit('"'), F.lit(""))
    return F.concat(F.lit('"'), bare(author), F.lit('" "'), bare(quote), F.lit('"'))


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(cell(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def model_tag(c: Column) -> Column:
    """Path-safe model name."""
    return F.regexp_replace(cell(c), r"[^A-Za-z0-9._-]+", "_")


def format_percent(value: float | None) -> str:
    """X15, on the driver: one decimal, blank for null, no negative zero."""
    if value is None or value != value:
        return ""
    return "0.0" if abs(value) < 0.05 else f"{value:.1f}"


def text_hash(c: Column) -> Column:
    """sha256 of the stripped text."""
    return F.sha2(cell(c), 256)


def safe_bool(c: Column) -> Column:
    """X18"""
    return F.lower(cell(c)).isin("true", "1", "yes", "y", "t")


def strict_true(c: Column) -> Column:
    return F.lower(cell(c)) == "true"
