"""Fame- and volume-balanced matching, repeated with seeded shuffles.

A run is sequential: each accepted match removes authors and moves the offset
between group means. Runs are independent, so each is one sequence of rows: the
table of authors (one row an author, not a row a quote) is repeated for every
run and sorted by Spark, the groups to choose from first and the shuffled
reference last, so a task keeps the former as packed columns (some 40 bytes an
author) and streams the latter. Positions are those of the remaining authors in
order of fame.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

MATCHED = "run_id int, grp string, author string, log10_hits double, count long, to_sample long, match_idx int"


Row = tuple[float, int, str]


def octave(count: int) -> int:
    """M3: whole octaves of a count."""
    return count.bit_length() - 1


class Octave:
    """Authors of one octave of quotes in order of (fame, quotes, author), as packed columns; taken ones are skipped by links."""

    def __init__(self):
        self.fame, self.count, self.after, self.ends, self.names = array("d"), array("q"), array("l"), array("q", [0]), bytearray()

    def add(self, fame: float, count: int, author: str) -> None:
        self.after.append(len(self.fame))
        self.fame.append(fame)
        self.count.append(count)
        self.names += author.encode("utf-8")
        self.ends.append(len(self.names))

    def row(self, k: int) -> Row:
        return self.fame[k], self.count[k], self.names[self.ends[k] : self.ends[k + 1]].decode("utf-8")

    def left(self, k: int) -> int:
        """The first place from k on that is not taken; the number of authors if none is."""
        end, after = k, self.after
        while end < len(after) and after[end] != end:
            end = after[end]
        while k < len(after) and after[k] != end and k != end:
            after[k], k = end, after[k]
        return end

    def first(self, target: float) -> int | None:
        k = self.left(bisect.bisect_left(self.fame, target))
        return k if k < len(self.fame) else None

    def last(self) -> int | None:
        """Taken authors at the end go for good."""
        while self.after and self.after[-1] != len(self.after) - 1:
            for column in (self.fame, self.count, self.after, self.ends):
                column.pop()
        return len(self.after) - 1 if self.after else None


class Pool:
    """Remaining authors of one group, by octaves of quotes."""

    def __init__(self, rows: list[Row] = ()):
        self.octaves: dict[int, Octave] = {}
        for row in sorted(rows):
            self.add(*row)

    def add(self, fame: float, count: int, author: str) -> None:
        """Rows come in order."""
        self.octaves.setdefault(octave(count), Octave()).add(fame, count, author)

    def nearest(self, target: float, most: int) -> tuple[int, int, Row] | None:
        """(octave, place, row) of the first author from target on in the octave of quotes, then in lower octaves, then in any; the last one if none is left above."""
        for b in range(most, -1, -1):
            rows = self.octaves.get(b)
            if rows and (k := rows.first(target)) is not None:
                return b, k, rows.row(k)
        places = [(b, k) for b, rows in self.octaves.items() if (k := rows.first(target)) is not None]
        pick = min if places else max
        places = places or [(b, k) for b, rows in self.octaves.items() if (k := rows.last()) is not None]
        return pick(((b, k, self.octaves[b].row(k)) for b, k in places), key=lambda x: x[2], default=None)

    def take(self, b: int, k: int) -> None:
        self.octaves[b].after[k] = k + 1


def matches(reference: Iterator[Row], pools: dict[str, Pool], limit: float = 1.0):
    """Each match (reference row, {group: row}, to_sample, squared error), in the order of the reference, which is already shuffled."""
    offsets = dict.fromkeys(pools, 0.0)
    for row in reference:
        picked = {g: p.nearest(row[0] - offsets[g], octave(row[1])) for g, p in pools.items()}
        if any(p is None for p in picked.values()):
            return
        error = sum((p[2][0] - row[0]) ** 2 for p in picked.values())
        if error < len(pools) * limit:
            for g, (b, k, p) in picked.items():
                offsets[g] += p[0] - row[0]
                pools[g].take(b, k)
            yield row, {g: p[2] for g, p in picked.items()}, min([row[1], *(p[2][1] for p in picked.values())]), error


def match_once(reference: list[Row], others: dict[str, list[Row]], limit: float = 1.0):
    """Matches (reference row, {group: row}, to_sample) and the total squared error; reference is already shuffled."""
    total, out = 0.0, []
    for *found, error in matches(iter(reference), {g: Pool(r) for g, r in others.items()}, limit):
        out.append(tuple(found))
        total += error
    return out, total


_MATCHED_TYPES = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]


def _matcher(reference: str, others: list[str], limit: float, batch_rows: int = 10_000):
    """mapInArrow function over runs in order, within a run the other groups before the reference."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MATCHED_TYPES)], names=[c.split(" ")[0] for c in MATCHED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, out = rows(batches), []
        held = next(todo, None)
        while held:
            run_id, pools = held[0], {g: Pool() for g in others}
            while held and held[0] == run_id and held[1] < len(others):
                pools[others[held[1]]].add(*held[2:])
                held = next(todo, None)

            def references() -> Iterator[Row]:
                nonlocal held
                while held and held[0] == run_id:
                    row, held = held[2:], next(todo, None)
                    yield row

            left = references()
            for k, (ref, picked, n, _) in enumerate(matches(left, pools, limit)):
                out += [(run_id, g, r[2], r[0], r[1], n, k) for g, r in [(reference, ref), *picked.items()]]
                if len(out) >= batch_rows:
                    yield packed(out)
                    out.clear()
            for _ in left:  # the rest of a run that ended early
                pass
        if out:
            yield packed(out)

    return run


def matched_runs(authors: DataFrame, reference: str, others: list[str], runs: int = 100, limit: float = 1.0, group: str = "grp", author: str = "author", fame: str = "log10_hits", count: str = "count") -> DataFrame:
    """Matched authors of every run, with how many quotes to sample of each."""
    rows = authors.where(F.col(group).isin(reference, *others)).select(F.col(group).alias("grp"), F.col(author).cast("string").alias("author"), F.col(fame).cast("double").alias("log10_hits"), F.col(count).cast("long").alias("count"))
    rows = rows.where("log10_hits is not null and count >= 1")
    side = F.array_position(F.array(*[F.lit(g) for g in [*others, reference]]), F.col("grp")).cast("int") - 1
    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_id"), side.alias("side"), "log10_hits", "count", "author")
    # The reference goes by its shuffle, the others by fame; a partition for each run, sorted with spilling.
    shuffled = F.col("side") == len(others)
    shuffle = F.when(shuffled, F.md5(F.concat_ws(":", "author", F.col("run_id").cast("string"))))
    order = ["run_id", "side", shuffle, F.when(shuffled, F.col("author")), "log10_hits", "count", "author"]
    dealt = each.repartitionById(runs, F.col("run_id")).sortWithinPartitions(*order)
    return dealt.select("run_id", "side", "log10_hits", "count", "author").mapInArrow(_matcher(reference, list(others), limit), MATCHED)


def run_stats(matched: DataFrame, reference: str, limit: float = 1.0) -> DataFrame:
    """Counts, mean fame, range of group means and root mean squared error of each run."""
    # Several readings, so the runs are matched once.
    matched = scratch.stored(matched)
    groups = matched.groupBy("run_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("log10_hits").alias("fame"))
    spread = groups.groupBy("run_id").agg(F.max("n").alias("authors_per_group"), F.avg("fame").alias("avg_fame"), (F.max("fame") - F.min("fame")).alias("fame_range"))
    ref = matched.where(F.col("grp") == reference).select("run_id", "match_idx", F.col("log10_hits").alias("ref"), "to_sample")
    quotes = ref.groupBy("run_id").agg(F.sum("to_sample").alias("quotes_per_group"))
    errors = matched.where(F.col("grp") != reference).join(ref.drop("to_sample"), ["run_id", "match_idx"]).groupBy("run_id").agg(F.sqrt(F.avg(F.pow(F.col("log10_hits") - F.col("ref"), 2))).alias("rms_error"))
    return spread.join(quotes, "run_id").join(errors, "run_id").withColumn("squared_error_limit", F.lit(float(limit)))


# Criteria for the best run, and whether less is better.
CRITERIA = [("authors_per_group", False), ("quotes_per_group", False), ("avg_fame", False), ("fame_range", True), ("rms_error", True)]


def sample_quotes(quotes: DataFrame, matched: DataFrame, author: str, key: str, seed: int = 42) -> DataFrame:
    """A seeded choice of to_sample quotes of each matched author (a row each), in the order of MD5."""
    wanted = matched.select(F.col("author").alias(author), "to_sample")
    # The greatest wish limits authors before the shuffle.
    most = wanted.agg(F.max("to_sample")).first()[0] or 0
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(author).orderBy(order, key)
    first = quotes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(most))
    return first.join(wanted, author).where("_rn <= to_sample").drop("_rn", "to_sample")
