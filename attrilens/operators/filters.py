"""Filters, flags and row slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The (race, gender) subgroups that are kept.
SUBGROUPS = [(r, g) for r in ("white", "black", "asian", "latino") for g in ("male", "female")]
MIN_WORDS, MAX_WORDS, FAME_FLOOR = 5, 30, 3.0


def in_subgroups(race: Column, gender: Column, subgroups=SUBGROUPS) -> Column:
    """P1"""
    return F.concat_ws("/", text.normalize_text(race), text.normalize_text(gender)).isin([f"{r}/{g}" for r, g in subgroups])


def not_blocked(author: Column, blocked: list[str]) -> Column:
    """P2"""
    return ~text.normalize_text(author).isin(blocked) if blocked else F.lit(True)


def non_blank(*columns: Column) -> Column:
    """P3, P7"""
    out = F.lit(True)
    for c in columns:
        out = out & (text.cell(c) != "")
    return out


def word_band(c: Column, low: int = MIN_WORDS, high: int = MAX_WORDS) -> Column:
    """P5, both ends included."""
    return text.count_words(c).between(low, high)


def clean_quotes(rows: DataFrame, author="author", quote="quote", race="race_ethnicity", gender="gender", blocked: list[str] | None = None, subgroups=SUBGROUPS) -> DataFrame:
    """P1 to P5 in the cheap-first order; Catalyst may reorder."""
    return (
        rows.where(in_subgroups(F.col(race), F.col(gender), subgroups))
        .where(not_blocked(F.col(author), blocked or []))
        .where(non_blank(F.col(author), F.col(quote)))
        .where(text.is_latinish(F.col(quote)))
        .where(word_band(F.col(quote)))
    )


def fame_floor(rows: DataFrame, column: str = "log10_hits", floor: float = FAME_FLOOR) -> DataFrame:
    """P6"""
    return rows.where(F.col(column) >= floor)


def drop_incomplete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """P7"""
    return rows.where(non_blank(*[F.col(c).cast("string") for c in columns]))


def demographic(c: Column) -> Column:
    """Missing values under one name."""
    value = text.cell(c)
    return F.when(value.isin("", "nan", "None"), "unknown").otherwise(value)


def base_prompt(prompt: Column) -> Column:
    """Without the context variant."""
    return F.regexp_replace(prompt, "_(labeled|unlabeled)$", "")


def prompt_by_prefix(prompt: Column, base: Column | None = None) -> Column:
    """P10: the longer prefix is tested first."""
    found = F.when(prompt.startswith("indirect_overt"), "indirect_overt").when(prompt.startswith("indirect"), "indirect").when(prompt.startswith("direct"), "direct")
    return found if base is None else F.coalesce(F.when(base != "", base), found)


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    """P11"""
    return rows.orderBy(order).limit(n)


def row_range(rows: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Positions from 1, both ends included; order holds positions from 0."""
    return rows.where(F.col(order).between(first - 1, last - 1))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows in a seeded shuffle (by MD5, so other engines can repeat it)."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def wide_to_long(rows: DataFrame, ids: list[str], prompts: list[str], suffix: str = "_response", value: str = "llm_output") -> DataFrame:
    """P12"""
    there = [p for p in prompts if f"{p}{suffix}" in rows.columns]
    renamed = rows.select(*ids, *[F.col(f"{p}{suffix}").alias(p) for p in there])
    return renamed.unpivot(ids, there, "prompt_type", value)


def dataset_of(path: Column, names: list[str]) -> Column:
    """The first name that the path holds."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.lower(path).contains(n), n).otherwise(out)
    return out


def outcome(correct: Column, any_name: Column) -> Column:
    """Correct, wrong (some name, not the right one) or none."""
    return F.when(correct, "correct").when(any_name, "wrong").otherwise("none")


def suppression(correct: Column, any_name: Column, with_context: bool) -> Column:
    """With context, not correct; without, no name."""
    return (~correct if with_context else ~any_name).cast("int")


def needs_query(rows: DataFrame, author: str, order: str) -> DataFrame:
    """Which labels of an author came from a model, by the author's first row."""
    flag = lambda c: F.coalesce(F.lower(F.min_by(c, order)) == "llm", F.lit(False))
    return rows.groupBy(author).agg(flag("race_source").alias("need_race"), flag("gender_source").alias("need_gender"))


def subgroup_label(race: Column, gender: Column, intersectional: bool) -> Column:
    """Like F/Black; the mode is a parameter."""
    r, g = F.coalesce(race, F.lit("")), F.coalesce(gender, F.lit(""))
    if not intersectional:
        return r
    key = F.lower(F.trim(g))
    short = F.when(key.isin("male", "m", "man"), "M").when(key.isin("female", "f", "woman"), "F")
    return F.when(short.isNotNull(), F.concat(short, F.lit("/"), F.initcap(r))).when(r != "", F.concat(g, F.lit("/"), r)).otherwise(g)


def subgroup_order(label: Column) -> Column:
    """gender_race in one order."""
    s = F.replace(F.lower(F.trim(label)), F.lit("-"), F.lit("_"))
    parts, genders = F.split(s, "_"), ("male", "female", "unknown")
    swap = (F.size(parts) == 2) & ~parts[0].isin(*genders) & F.get(parts, F.lit(1)).isin(*genders)
    return F.when(swap, F.concat(F.get(parts, F.lit(1)), F.lit("_"), parts[0])).otherwise(s)


def split_groups(rows: DataFrame, group: str, reference: str, others: list[str]) -> DataFrame:
    """Role reference or other, rows of other groups left out."""
    return rows.where(F.col(group).isin(reference, *others)).withColumn("role", F.when(F.col(group) == reference, "reference").otherwise("other"))


def not_local(c: Column) -> Column:
    """P20"""
    return ~c.rlike(r"(?i)\blocal\b")
