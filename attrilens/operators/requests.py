"""Requests for models: manifests, prompts and provider bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .joins import expand
from .windows import chunk

# Fixed value: the system message.
SYSTEM = "You are a helpful assistant that provides concise, factual responses. Answer concisely. Do NOT repeat the quote. Answer in maximum 1 sentence."


# Most requests of a batch, by form of the request.
BATCH_SIZES = {"responses": 20_000, "chat": 48_000, "contents": 1_200, "messages": 100_000}


def batched(rows: DataFrame, provider: str, index: str) -> DataFrame:
    """Rows with the number of the batch that each goes in; index holds positions from 0."""
    return rows.withColumn("batch", chunk(F.col(index), BATCH_SIZES[provider]))


def manifest(quotes: DataFrame, runs: int, prompts: list[str] | None = None, contexts: tuple[str, ...] = (), keep: tuple[str, ...] = ("author", "gender", "race_ethnicity", "quote")) -> DataFrame:
    """One row a request, with its id."""
    rows = expand(quotes, prompts or list(text.PROMPTS), runs, contexts)
    parts = [F.col("quote_id"), F.col("prompt_type"), *([F.col("context_variant")] if contexts else []), F.concat(F.lit("run"), F.col("run").cast("string"))]
    return rows.select(text.request_id(*parts).alias("request_id"), "quote_id", "prompt_type", *(["context_variant"] if contexts else []), "run", *[c for c in (*keep, *(["context"] if contexts and "context" in rows.columns else [])) if c in rows.columns])


def with_prompt(rows: DataFrame, quote: str = "quote", context: str | None = None) -> DataFrame:
    """X10"""
    templates = text.CONTEXT_PROMPTS if context else text.PROMPTS
    out = F.lit(None).cast("string")
    for name, template in templates.items():
        fields = {"passage": F.col(quote)} | ({"context": F.col(context)} if context else {})
        out = F.when(F.col("prompt_type") == name, text.render(template, **fields)).otherwise(out)
    return rows.withColumn("prompt", out)


def batch_body(rows: DataFrame, provider: str, model: str, max_tokens: int = 256, temperature: float = 0.0, system: str | None = SYSTEM) -> DataFrame:
    """The JSON line of each request as a provider wants it, as column value."""
    user = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    told = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
    messages = F.array(told, user) if system else F.array(user)
    common = [F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature")]
    if provider == "chat":
        line = F.struct(F.col("request_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(*common, messages.alias("messages")).alias("body"))
    elif provider == "responses":
        line = F.struct(F.col("request_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), F.struct(F.lit(model).alias("model"), F.lit(system).alias("instructions"), F.col("prompt").alias("input"), F.lit(max_tokens).alias("max_output_tokens")).alias("body"))
    elif provider == "messages":
        line = F.struct(F.col("request_id").alias("custom_id"), F.struct(*common, F.lit(system).alias("system"), F.array(user).alias("messages")).alias("params"))
    elif provider == "contents":
        parts = F.array(F.struct(F.array(F.struct(F.col("prompt").alias("text"))).alias("parts"), F.lit("user").alias("role")))
        line = F.struct(F.col("request_id").alias("key"), F.struct(parts.alias("contents")).alias("request"))
    else:
        raise ValueError(provider)
    return rows.select(F.to_json(line).alias("value"))
