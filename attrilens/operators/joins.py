"""Joins between stages: fame, reuse, demographics, expansion, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def fame_of_authors(rows: DataFrame, hits: DataFrame, clean: str, raw: str) -> DataFrame:
    """One hit for each clean author: that of the least raw name that has one."""
    found = rows.select(clean, raw).distinct().join(hits, F.col(raw) == hits["author"])
    return found.groupBy(clean).agg(F.min_by("google_hits", raw).alias("google_hits"))


def override(base: DataFrame, preferred: DataFrame, key: str) -> DataFrame:
    """Rows of both, preferred ones where both have a key."""
    both = base.withColumn("_rank", F.lit(1)).unionByName(preferred.withColumn("_rank", F.lit(0)))
    return both.groupBy(key).agg(*[F.min_by(c, "_rank").alias(c) for c in base.columns if c != key])


def with_responses(manifest: DataFrame, responses: DataFrame, key: str, fill: str = "llm_output") -> DataFrame:
    """Every manifest row, missing text as blank."""
    return manifest.join(responses, key, "left").fillna("", [fill])


def split_reusable(manifest: DataFrame, earlier: DataFrame, key: str, order: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an earlier result (the last one), and rows still to do."""
    last = earlier.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])
    return manifest.join(last, key), manifest.join(last.select(key), key, "left_anti")


def reuse_same(rows: DataFrame, earlier: DataFrame, keys: list[str], same: list[str], order: str, value: str = "llm_output") -> DataFrame:
    """The last earlier result by key if its quote and context are the same; others stay null."""
    last = earlier.groupBy(*keys).agg(*[F.max_by(c, order).alias(f"_{c}") for c in (*same, value)])
    equal = [text.cell(F.col(c)) == text.cell(F.col(f"_{c}")) for c in same]
    ok = equal[0]
    for e in equal[1:]:
        ok = ok & e
    return rows.join(last, keys, "left").withColumn(value, F.when(ok, F.col(f"_{value}"))).drop(*[f"_{c}" for c in (*same, value)])


def with_counts(authors: DataFrame, counts: DataFrame, key: str = "author_clean") -> DataFrame:
    """J6"""
    return authors.join(counts, key, "left")


def with_demographics(rows: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Own values first, then those of the dataset."""
    found = rows.join(meta.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    for c in columns:
        found = found.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")) if c in rows.columns else F.col(f"_{c}"))
    return found.drop(*[f"_{c}" for c in columns])


def members(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """J11"""
    return rows.join(chosen, keys, "left_semi")


def retrieval_rows(targets: DataFrame, corpus: DataFrame, idx: str = "idx") -> DataFrame:
    """The corpus row of each target: by id (equal text first, then the first row), else by text hash; others go.

    Both have quote_id and quote; corpus has idx, a row number.
    """
    t = targets.withColumns({"_qid": text.cell(F.col("quote_id")), "_quote": text.cell(F.col("quote"))})
    c = corpus.select(text.cell(F.col("quote_id")).alias("_qid"), text.cell(F.col("quote")).alias("_cq"), F.col(idx).alias("_i"))
    first = c.groupBy("_qid").agg(F.min("_i").alias("_first"))
    same = c.groupBy("_qid", "_cq").agg(F.min("_i").alias("_same")).withColumnRenamed("_cq", "_quote")
    hashed = c.groupBy(F.sha2("_cq", 256).alias("_h")).agg(F.min("_i").alias("_hashed"))
    found = t.join(first, "_qid", "left").join(same, ["_qid", "_quote"], "left").withColumn("_h", F.sha2("_quote", 256)).join(hashed, "_h", "left")
    chosen = F.when(F.col("_first").isNotNull(), F.coalesce("_same", "_first")).otherwise(F.col("_hashed"))
    return found.withColumn("retrieval_idx", chosen).where("retrieval_idx is not null").drop("_qid", "_quote", "_first", "_same", "_h", "_hashed")


def demographic_pairs(errors: DataFrame, people: DataFrame, right: str = "author", named: str = "mentioned") -> DataFrame:
    """Race and gender of both authors; rows without either go."""
    a = people.select(F.col("author").alias(right), F.col("race").alias("true_race"), F.col("gender").alias("true_gender"))
    b = people.select(F.col("author").alias(named), F.col("race").alias("named_race"), F.col("gender").alias("named_gender"))
    return errors.join(a, right).join(b, named)


def expand(quotes: DataFrame, prompts: list[str], runs: int, contexts: tuple[str, ...] = ()) -> DataFrame:
    """A row for each quote, prompt, run and context variant; the lists are literals, so nothing is joined."""
    out = quotes.withColumn("prompt_type", F.explode(F.array(*[F.lit(p) for p in prompts])))
    if contexts:
        out = out.withColumn("context_variant", F.explode(F.array(*[F.lit(c) for c in contexts])))
    return out.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def subgroup_pairs(groups: DataFrame, order: str, value_columns: list[str]) -> DataFrame:
    """Pairs of subgroups in order; groups are a handful of aggregate rows."""
    a = groups.select(*[F.col(c).alias(f"{c}_a") for c in (order, *value_columns)])
    b = groups.select(*[F.col(c).alias(f"{c}_b") for c in (order, *value_columns)])
    return a.join(b, F.col(f"{order}_a") < F.col(f"{order}_b"))


def key_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys."""
    return a.join(b, keys, "full_outer")
