"""Spelling variants: words one error apart, through forward and backward automata (operator 12).

Words are counted before they are shuffled. Near words share a half exactly:
with the error in the second half the first is equal, and the other way round.
Each word is dealt to a task by its first letters and to another by its last
ones (as many as the shortest half has). A task builds the minimal acyclic
automaton of its words (of the reversed words for the second way), whose states
hold counts, so that a path gives a word's number. A word is looked up by
walking its equal half and completing the other with one error. Numbers remove
what several paths find; of the two ways, the one whose half holds the first
difference counts a pair, so no pair is ever shuffled: a task returns one row a
word with its count of near words and the best of them.

Letters that more than ``most_rows`` words share are dealt again, first by the
whole half, then by half the rest on either side of the error, until groups are
small: words that are equal but for one letter are at most a few hundred.

Defined results: null and empty texts have no words; a null id counts as an
empty one in the hash; repeated rows count as often as they stand; a word
without near words has no form and is its own root; words of any length are
matched whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least code points and occurrences of a word, how much more frequent its form is, and one of how many runs loses a letter.
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 7, 2, 10, 31
#: Words of a task's automaton, and how many may share the letters that deal them out.
ROWS_PER_TASK, MOST_ROWS = 30_000, 30_000
#: Characters of words that a counting task keeps before it sends them on.
KEPT_CHARS = 4 << 20
RUN = re.compile("[A-Za-zÀ-ÿ]+")


class Automaton:
    """Minimal acyclic automaton of sorted, distinct words; a word's number is its place among them."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []  # letter: state, words of this state before that letter
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[str], list[int]]] = [([], [])]
        ends = [False]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                letters, targets = path.pop()
                state = (ends.pop(), *letters, *targets)
                at = known.get(state)
                if at is None:
                    at = known[state] = self._add(state[0], letters, targets)
                path[-1][1].append(at)

        before = ""
        for w in words:
            depth = _common_prefix(before, w)
            close(depth)
            for c in w[depth:]:
                path[-1][0].append(c)
                path.append(([], []))
                ends.append(False)
            ends[-1] = True
            before = w
        close(0)
        self.start = self._add(ends[0], *path[0])

    def _add(self, final: bool, letters: list[str], targets: list[int]) -> int:
        n, out = int(final), {}
        for c, t in zip(letters, targets):
            out[c] = (t, n)
            n += self.count[t]
        self.edges.append(out)
        self.final.append(final)
        self.count.append(n)
        return len(self.edges) - 1

    def _number(self, state: int, number: int, word: str, at: int) -> int:
        """Number of the word that goes on with word[at:] from a state, or -1."""
        edges = self.edges
        for k in range(at, len(word)):
            step = edges[state].get(word[k])
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, low: int, high: int) -> set[int]:
        """Numbers of the words that differ from word by one error in word[low:high], and nowhere else."""
        state, number, hits, n = self.start, 0, set(), len(word)
        for k in range(low):
            step = self.edges[state].get(word[k])
            if step is None:
                return hits
            state = step[0]
            number += step[1]
        for k in range(low, high + 1):
            c = word[k : k + 1]
            # An error in a run of one letter is taken at the run's last place.
            if k < high and (k == high - 1 or word[k + 1] != c):
                hits.add(self._number(state, number, word, k + 1))
            for x, (target, skipped) in self.edges[state].items():
                if x != c:
                    if k < high:
                        hits.add(self._number(target, number + skipped, word, k + 1))
                    hits.add(self._number(target, number + skipped, word, k))
                elif k == high:
                    hits.add(self._number(target, number + skipped, word, k))
            step = self.edges[state].get(c)
            if step is None:
                break
            state = step[0]
            number += step[1]
        hits.discard(-1)
        return hits


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a[:low] == b[:low], a[:n] != b[:n]
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def segment(path: str, n: int) -> tuple[int, int]:
    """Places of a word of n letters where a path has its error: each letter of the path takes the left or right half."""
    low, high = 0, n
    for side in path:
        mid = (low + high) // 2
        low, high = (mid, high) if side == "R" else (low, mid)
    return low, high


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        size = 0

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in common.slices(batches, "text"):
            for key, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1))):
                start = zlib.crc32(f"{key or ''}:".encode())
                for w, n in Counter(RUN.findall(text.lower().decode(errors="replace"))).items():
                    h = zlib.crc32(w.encode(), start)
                    if damaged and not h % damaged:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                    if len(w) >= least_length:
                        if w not in seen:
                            size += len(w) + 16
                        seen[w] += n
                if size > KEPT_CHARS:
                    size = 0
                    yield sent()
        yield sent()

    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _dealt(rows: DataFrame, level: int, least_length: int) -> DataFrame:
    """Rows (word, n, path, lengths) as (key, path, word, n, lengths): the letters that deal a word out at this level.

    A word stands for lookups of words of its length and of one letter less or
    more; lengths has a bit for each, the middle one for its own lookup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for w, n, path, lengths in zip(*[c.to_pylist() for c in batch.columns]):
                for p in [path] if level < 2 else [path + "L", path + "R"]:
                    keys: dict[int, int] = {}
                    for bit, k in ((1, -1), (2, 0), (4, 1)):
                        if lengths & bit:
                            if level:
                                low, high = segment(p, len(w) + k)
                                if low == high:
                                    continue
                                head, tail = w[:low], w[high - k :]
                            else:
                                head, tail = (w[: least_length // 2], "") if p == "R" else ("", w[least_length // 2 - least_length :])
                            key = xxhash.xxh64_intdigest(f"{p} {head} {tail}") - (1 << 63)
                            keys[key] = keys.get(key, 0) | bit
                    out += [(key, p, w, n, bits) for key, bits in keys.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["key", "path", "word", "n", "lengths"])

    return rows.select("word", "n", "path", "lengths").mapInArrow(run, "key long, path string, word string, n long, lengths int")


_FOUND = "word string, n long, n_near long, best_n long, best string"


def _looked_up(table: pa.Table) -> pa.Table:
    """One task's words, all of one direction: a row for each lookup."""
    rows = list(zip(*[table.column(c).to_pylist() for c in ("path", "word", "n", "lengths")]))
    back = rows[0][0][0] == "L"
    turned = (lambda w: w[::-1]) if back else (lambda w: w)
    n_of = {w: n for _, w, n, _ in rows}
    words = sorted(map(turned, n_of))
    automaton = Automaton(words)
    out = []
    for path, w, n, lengths in rows:
        if not lengths & 2:
            continue
        low, high = segment(path, len(w))
        found = automaton.one_error(w[::-1], len(w) - high, len(w) - low) if back else automaton.one_error(w, low, high)
        near = [turned(words[k]) for k in found]
        # The first difference tells which lookup a pair belongs to.
        near = [v for v in near if low <= (k := _common_prefix(w, v)) < high or k == high == len(w)]
        best = min(near, key=lambda v: (-n_of[v], v), default=None)
        out.append((w, n, len(near), n_of.get(best), best))
    columns = zip(*out) if out else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n", "n_near", "best_n", "best"])


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, rows_per_task: int = ROWS_PER_TASK, most_rows: int = MOST_ROWS) -> DataFrame:
    """(word, n, n_near, best_n, best) of a table of words (word, n): how many near words, and the most frequent (ties: least)."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    both = F.explode(F.array(F.lit("R"), F.lit("L")))
    rows = common.stored(_dealt(words.select("word", "n", both.alias("path"), F.lit(7).alias("lengths")), 0, least_length))
    found = []
    # Halves of halves end when one letter is left.
    for level in range(longest.bit_length() + 2):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
        hot = common.cut(sizes.where(F.col("n_rows") > most_rows).select("key"))
        n_hot = hot.count() if level <= longest.bit_length() else 0
        few = rows.join(hot, "key", "left_anti") if n_hot else rows
        n_tasks = max(1, -(-rows.count() // rows_per_task))
        tasks = few.groupBy(F.substring("path", 1, 1).alias("side"), F.pmod("key", F.lit(n_tasks)).alias("task"))
        found.append(tasks.applyInArrow(_looked_up, _FOUND))
        if not n_hot:
            break
        rows = common.stored(_dealt(rows.join(hot, "key", "left_semi"), level + 1, least_length))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct(-F.col("best_n"), F.col("best"), F.col("best_n"))))
    return every.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", F.col("b.best_n").alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, **parameters) -> DataFrame:
    """(word, form, root, n, n_near, form_n): form is the best near word if it is ratio times as frequent; root ends the chain of forms."""
    near = near_words(words, **parameters)
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = common.stored(near.select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    # A form is more frequent by the ratio, so chains are short; each round doubles the steps taken.
    chain = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.stored(chain.join(further, "root", "left"))
        chain = step.select("word", F.coalesce("next", "root").alias("root"))
        if not step.where("next is not null").limit(1).count():
            break
    out = rows.join(chain, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.stored(counts(common.table(spark, sf_dir, "documents"))))


OP12_SQL = rf"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
counted AS (SELECT doc_id, r, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS b FROM runs GROUP BY doc_id, r),
hashed AS (SELECT r, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(b) // 2), lambda i: ('0x' || substr(b, 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(t[1 + (xor(a, x) & 255)], a >> 8))) AS h FROM counted, crc_table),
edited AS (SELECT n, CASE WHEN h % {DAMAGED} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
shorter AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.d = w.word UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.d = w.word),
ranked AS (SELECT p.word, o.word AS best, o.n AS best_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, o.word) AS k FROM near p JOIN words o ON p.other = o.word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1),
chain AS (SELECT word, word AS reached, 0 AS depth FROM formed UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN formed f ON c.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(reached, depth) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""
