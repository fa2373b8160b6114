"""Services outside the cluster, behind one interface: replayed from a table or called in partitions.

Retries, rate limits and cooldowns belong to a client (S17 to S24, N16, N17);
queries only see requests and responses.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Replay:
    """Responses recorded in a table (key, response)."""

    def __init__(self, recorded: DataFrame, key: str = "key", response: str = "response"):
        self.recorded = recorded.select(F.col(key).alias("key"), F.col(response).alias("response"))

    def ask(self, requests: DataFrame, key: str) -> DataFrame:
        """requests with response, null where nothing is recorded."""
        return requests.join(self.recorded, requests[key] == self.recorded["key"], "left").drop(self.recorded["key"])


class Limiter:
    """At most so many calls in a sliding window, for one process."""

    def __init__(self, calls: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep, self.past = calls, seconds, clock, sleep, []

    def wait(self) -> None:
        while True:
            now = self.clock()
            self.past = [t for t in self.past if now - t < self.seconds]
            if len(self.past) < self.calls:
                self.past.append(now)
                return
            self.sleep(self.seconds - (now - self.past[0]))


class StatusError(Exception):
    """A service's answer with an error status; wait is what it asks for, in seconds."""

    def __init__(self, status: int, message: str = "", wait: float | None = None):
        super().__init__(message or f"status {status}")
        self.status, self.wait = status, wait


#: Statuses that are tried again, and how much longer the wait is for throttled ones.
RETRIED = {403: 4.0, 408: 1.0, 409: 1.0, 425: 1.0, 429: 4.0, 500: 1.0, 502: 1.0, 503: 2.0, 504: 1.0}


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, factor: float = 1.0, jitter: float = 0.1, rng: random.Random | None = None) -> float:
    """Doubling waits with jitter; factor lengthens them for throttled statuses."""
    return min(most, base * 2**attempt * factor) * (1 + jitter * (rng or random).random())


def retry_wait(error: Exception, attempt: int, base: float = 1.0, most: float = 60.0, jitter: float = 0.1) -> float | None:
    """Seconds until the next attempt, None if the error is final."""
    if not isinstance(error, StatusError):
        return backoff(attempt, base, most, jitter=jitter)
    if error.status not in RETRIED:
        return None
    wait = backoff(attempt, base, most, RETRIED[error.status], jitter)
    return max(wait, error.wait) if error.wait is not None else wait


class Live:
    """A client called once a row inside partitions; client() is made in each task.

    threads calls run at a time. Calls that fail are tried again after
    ``retry_wait``; the last error is kept.
    """

    def __init__(self, client: Callable[[], Callable[[str], str]], retries: int = 6, per_minute: int | None = None, threads: int = 1, base: float = 1.0, most: float = 60.0):
        self.client, self.retries, self.per_minute = client, retries, per_minute
        self.threads, self.base, self.most = threads, base, most

    def ask(self, requests: DataFrame, key: str) -> DataFrame:
        make, retries, per_minute, threads, base, most = self.client, self.retries, self.per_minute, self.threads, self.base, self.most

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, limit, turn = make(), Limiter(per_minute) if per_minute else None, threading.Lock()

            def one(request: str) -> tuple[str | None, str | None]:
                for attempt in range(retries + 1):
                    if limit:
                        with turn:
                            limit.wait()
                    try:
                        return call(request), None
                    except Exception as e:
                        wait = retry_wait(e, attempt, base, most)
                        if wait is None or attempt == retries:
                            return None, str(e)[:500]
                        time.sleep(wait)
                return None, None

            with ThreadPoolExecutor(threads) as pool:
                for part in parts:
                    out = list(pool.map(one, part[key]))
                    yield part.assign(response=[r for r, _ in out], error=[e for _, e in out])

        return requests.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", response string, error string")


def corpus_counts(responses: DataFrame, key: str) -> DataFrame:
    """Count, approximation flag, number of query tokens and latency of each counted name; failed ones have an error."""
    get = lambda path: F.get_json_object("response", path)
    tokens = F.size(F.from_json(get("$.token_ids"), "array<long>"))
    return responses.select(key, get("$.count").cast("long").alias("count"), F.coalesce(get("$.approx").cast("boolean"), F.lit(False)).alias("approx"), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).alias("n_tokens"), get("$.latency").cast("double").alias("latency_ms"), F.coalesce("error", get("$.error")).alias("error"))


def chosen_label(responses: DataFrame, key: str, options: list[str], label: str) -> DataFrame:
    """The option that a multiple-choice answer names by letter, number or text; null if none."""
    from ..functions.text import cell, decode_choice

    answer = F.regexp_replace(cell(F.col("response")), r"^\(?([A-Za-z])[).:]?(\s.*)?$", "$1")
    return responses.select(key, decode_choice(answer, F.array(*[F.lit(o) for o in options])).alias(label))


def validated(people: DataFrame, answers: dict[str, DataFrame], key: str) -> DataFrame:
    """For each label (race, gender) the earlier model's value, the second provider's, and whether they agree.

    people has a need_* flag and a first_* value for each label; answers has the second provider's label by key.
    Authors that need none keep null; labels are judged independently.
    """
    out = people
    for label, found in answers.items():
        out = out.join(found.select(key, F.col(label).alias(f"second_{label}")), key, "left")
        needed = F.col(f"need_{label}")
        out = out.withColumn(f"second_{label}", F.when(needed, F.col(f"second_{label}")))
        out = out.withColumn(f"agree_{label}", F.when(needed, F.coalesce(F.lower(F.trim(f"first_{label}")) == F.lower(F.trim(f"second_{label}")), F.lit(False))))
    return out


def fetch_vectors(missing: DataFrame, client: Callable[[], Callable[[list[str]], list[list[float]]]], per_call: int = 128, retries: int = 6, base: float = 1.0) -> DataFrame:
    """(hash, embedding) of texts (hash, text), fetched many at a time; calls that fail are tried again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for part in parts:
            found: list[list[float]] = []
            for at in range(0, len(part), per_call):
                texts = part["text"].iloc[at : at + per_call].tolist()
                for attempt in range(retries + 1):
                    try:
                        found += call(texts)
                        break
                    except Exception as e:
                        wait = retry_wait(e, attempt, base)
                        if wait is None or attempt == retries:
                            raise
                        time.sleep(wait)
            yield pd.DataFrame({"hash": part["hash"], "embedding": found})

    return missing.select("hash", "text").mapInPandas(run, "hash string, embedding array<float>")


def first_success(candidates: DataFrame, keys: list[str], rank: str, values: list[str]) -> DataFrame:
    """The first candidate by rank that has a value, column by column."""
    return candidates.groupBy(*keys).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(rank))).alias(v) for v in values])


def missing_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose hash has no vector yet."""
    from ..functions.text import text_hash

    return texts.select(text_hash(F.col("text")).alias("hash"), "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")
