"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least ``max(LEAST, TIMES * q)``, so
max(6, 4 q), words long and that no neighbouring word extends. ``collapsed`` finds every run of every text and drops the words that
follow a run's first period.

Steps, for many texts at once as one sequence of word numbers in which a separator of its own follows each stretch:

1. Word sequences are named by doubling (equal names, equal sequences), which gives the suffix array and the longest common extension of
   any two places, forwards and backwards. The suffix tree is held as suffix array with common prefixes: a node or a place on
   an edge is an interval of the array and a depth; its suffix link is the interval around the next place, one shallower.
2. The sequence is cut into Lempel-Ziv blocks. Squares that begin in a block and end in it or in the next one follow from common
   extensions at the block's borders; they cover the leftmost occurrence of every kind of square.
3. From each of these, suffix links are walked: the square without its first word, then that word at the end. Where the text goes on with
   it, the next kind lies one place on; elsewhere the tree is asked for another occurrence that does. Walks stop at a
   square already walked from. This completes the vocabulary of squares.
4. Squares are located at all leaves below them, and located squares of one period at neighbouring places merge into runs. Squares whose
   root is a repetition itself are left out before step 3 (their root's run has them): there may be a quadratic number of them.

What can be no part of a run is left out first: every three consecutive words of a run occur in it at least three times. So only
stretches of four or more consecutive such triples enter step 1. No run is lost by that, and ordinary prose hardly reaches the steps above.

Memory follows a slice of ``SLICE`` bytes of text, or one text. Defined results for odd input: a null, empty or white text has no words, no
runs and an empty collapsed text; null ids are kept; repeated rows are judged each; texts of any length are read whole; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import textkit as tk

LEAST, TIMES = 6, 4
#: Consecutive words that occur ``TIMES`` - 1 times or more wherever they lie in a run.
TRIPLE = 3
SLICE = 1 << 20


def ranges(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, number) of all numbers of the ranges that begin at ``first``."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


class SuffixTree:
    """Common extensions, intervals and suffix links of one sequence of numbers."""

    def __init__(self, sequence: np.ndarray):
        self.n = n = len(sequence)
        self.names = [np.unique(sequence, return_inverse=True)[1].astype(np.int64)]
        while self.names[-1].max() < n - 1:
            low, step = self.names[-1], 1 << (len(self.names) - 1)
            high = np.zeros(n, np.int64)
            high[: max(0, n - step)] = low[step:] + 1
            self.names.append(np.unique(low * (n + 1) + high, return_inverse=True)[1])
        self.rank = self.names[-1]
        self.order = np.argsort(self.rank)
        self.names = [x.astype(np.int32) for x in self.names]
        self.common = np.zeros(n + 1, np.int64)
        self.common[1:n] = self.forward(self.order[:-1], self.order[1:])
        #: Least common prefix of 2^level neighbours in the array, from each place on.
        self.least = [self.common]
        while 2 << (len(self.least) - 1) <= n + 1:
            below, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(below[:-step], below[step:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal."""
        total = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            a, b, size = i + total, j + total, 1 << level
            inside = np.flatnonzero(np.maximum(a, b) + size <= self.n)
            name = self.names[level]
            total[inside[name[a[inside]] == name[b[inside]]]] += size
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j are equal."""
        total = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size = 1 << level
            a, b = i - total - size, j - total - size
            inside = np.flatnonzero(np.minimum(a, b) >= 0)
            name = self.names[level]
            total[inside[name[a[inside]] == name[b[inside]]]] += size
        return total

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the array of the suffixes that share ``depth`` words with those at ``at``."""
        low, high = self.rank[at].astype(np.int64), self.rank[at].astype(np.int64)
        for level in range(len(self.least) - 1, -1, -1):
            least, step = self.least[level], 1 << level
            down = np.flatnonzero(low - step >= 0)
            low[down[least[low[down] - step + 1] >= depth[down]]] -= step
            up = np.flatnonzero(high + step < self.n)
            high[up[least[high[up] + 1] >= depth[up]]] += step
        return low, high

    def squares(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval and period of squares."""
        return *self.interval(at, 2 * period), period

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A suffix of each interval with ``word`` (a place that holds it) after ``depth`` words, -1 if there is none."""
        wanted, letters, last = self.names[0][word], self.names[0], high.copy()
        while True:
            open_ = np.flatnonzero(low < last)
            if not len(open_):
                break
            mid = (low[open_] + last[open_]) // 2
            end = self.order[mid] + depth[open_]
            seen = np.where(end < self.n, letters[np.minimum(end, self.n - 1)], -1)
            less = seen < wanted[open_]
            low[open_[less]] = mid[less] + 1
            last[open_[~less]] = mid[~less]
        at = self.order[low]
        end = at + depth
        return np.where((end < self.n) & (letters[np.minimum(end, self.n - 1)] == wanted), at, -1)

    def earlier(self) -> np.ndarray:
        """Length of the longest sequence from each place on that also begins at an earlier place."""
        n = self.n
        before, after, ranks = list(range(-1, n - 1)), [*range(1, n), -1], self.rank.tolist()
        left, right = [0] * n, [0] * n
        for at in range(n - 1, -1, -1):
            r = ranks[at]
            b, a = before[r], after[r]
            left[at], right[at] = b, a
            if b >= 0:
                after[b] = a
            if a >= 0:
                before[a] = b
        found = np.zeros(n, np.int64)
        for side in (np.array(left), np.array(right)):
            some = np.flatnonzero(side >= 0)
            found[some] = np.maximum(found[some], self.forward(some, self.order[side[some]]))
        return found


def blocks(tree: SuffixTree) -> np.ndarray:
    """First place of every Lempel-Ziv block."""
    sizes, at, found = np.maximum(tree.earlier(), 1).tolist(), 0, []
    while at < tree.n:
        found.append(at)
        at += sizes[at]
    return np.array(found, np.int64)


def leftmost_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of squares that cover the leftmost occurrence of every kind of square."""
    first = blocks(tree)
    end = np.append(first[1:], tree.n)
    size = end - first
    after = np.append(size[1:], 0)
    letters = tree.names[0]
    # The left half's last word lies in the block: the right half begins at the border or before it.
    of, period = ranges(np.ones(len(size), np.int64), size)
    border, other = end[of], end[of] - period
    use = np.flatnonzero(border < tree.n)
    use = use[letters[border[use]] == letters[other[use]]]
    border, other, period_a = border[use], other[use], period[use]
    ahead, behind = tree.forward(border, other), tree.backward(border, other)
    start_a = np.maximum(other - behind, other - period_a + 1)
    good = ahead + behind >= period_a
    start_a, period_a = start_a[good], period_a[good]
    # The right half's words meet the block's first word: the square begins there or before, and reaches over the block's start.
    of, period = ranges(np.ones(len(size), np.int64), size + after)
    border, other = first[of], first[of] + period
    use = np.flatnonzero(other < tree.n)
    use = use[letters[border[use]] == letters[other[use]]]
    border, other, period = border[use], other[use], period[use]
    ahead, behind = tree.forward(border, other), tree.backward(border, other)
    start = np.maximum(border - behind, border - period + 1)
    good = ahead + behind >= period
    return np.concatenate((start_a, start[good])), np.concatenate((period_a, period[good]))


def primitive(tree: SuffixTree, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which squares repeat a root that is no repetition itself; turning a square round does not change that."""
    good, rest = np.ones(len(at), bool), period.copy()
    factor = least_factors(int(period.max(initial=1)))
    while (some := np.flatnonzero(rest > 1)).size:
        prime = factor[rest[some]]
        part = period[some] // prime
        good[some[tree.forward(at[some], at[some] + part) >= 2 * period[some] - part]] = False
        rest[some] //= prime
    return good


def vocabulary(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first and last place in the array, period): every kind of square with a primitive root, once."""
    at, period = leftmost_squares(tree)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [tree.squares(at[:0], period[:0])]
    walked: set[tuple[int, int]] = set()
    while len(at):
        use = primitive(tree, at, period)
        at, period = at[use], period[use]
        low, _, _ = tree.squares(at, period)
        fresh = []
        for k, mark in enumerate(zip(low.tolist(), period.tolist(), strict=True)):
            if mark not in walked:
                walked.add(mark)
                fresh.append(k)
        at, period = at[fresh], period[fresh]
        # As far as the text goes on, the next kinds lie at the next places; a whole turn has all kinds.
        onward = tree.forward(at, at + period) - period
        of, place = ranges(at, np.minimum(onward + 1, period))
        found.append(tree.squares(place, period[of]))
        part = np.flatnonzero(onward < period - 1)
        last, period = at[part] + onward[part], period[part]
        low, high = tree.interval(last + 1, 2 * period - 1)
        at = tree.child(low, high, 2 * period - 1, last + period)
        at, period = at[at >= 0], period[at >= 0]
    low, high, period = (np.concatenate(x) for x in zip(*found, strict=True))
    _, once = np.unique(low * (tree.n + 1) + period, return_index=True)
    return low[once], high[once], period[once]


def least_factors(most: int) -> np.ndarray:
    """The smallest prime factor of each number up to ``most``."""
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    return factor


def runs_of(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period."""
    if len(sequence) < LEAST:
        none = np.zeros(0, np.int64)
        return none, none, none
    tree = SuffixTree(sequence)
    low, high, period = vocabulary(tree)
    of, place = ranges(low, high - low + 1)
    at, q = tree.order[place], period[of]
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    new = np.ones(len(at), bool)
    new[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, q = at[first], q[first]
    length = (at[last] - start + 2 * q) if len(first) else start
    keep = length >= np.maximum(LEAST, TIMES * q)
    start, length, q = start[keep], length[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def repetitive(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of every stretch that may hold runs; ``first`` has each text's first word and the total."""
    at, row = tk.within_rows(first, TRIPLE)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    triple = tk.mix(tk.grams(words, TRIPLE, 61)[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 63)
    _, which, times = np.unique(triple, return_inverse=True, return_counts=True)
    often = times[which] >= TIMES - 1
    at, row = at[often], row[often]
    if not len(at):
        return none, none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    long = size >= LEAST - TRIPLE + 1
    return at[start[long]], size[long] + TRIPLE - 1


def runs_in_texts(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of many texts given by word hashes; starts count from each text's first word."""
    start, size = repetitive(words, first)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none, none
    of, place = ranges(start, size)
    number = np.unique(words[place], return_inverse=True)[1]
    joined = np.zeros(len(place) + len(start), np.int64)
    where = np.full(len(joined), -1, np.int64)
    to = np.arange(len(place)) + of
    joined[to], where[to] = number, place
    joined[where < 0] = number.max() + 1 + np.arange(len(start))
    begin, length, period = runs_of(joined)
    begin = where[begin]
    text = np.searchsorted(first, begin, "right") - 1
    order = np.lexsort((period, begin))
    return text[order], (begin - first[text])[order], length[order], period[order]


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``runs`` (array of start, length, period by start, then period; words are numbered from 0), ``n_words``, ``kept_words`` and
    ``collapsed``, the kept words joined by single spaces."""
    storage.bounded_batches(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = [id_col, "runs", "n_words", "kept_words", "collapsed"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, space = tk.WordHasher(), tk.separators("space")
        for batch in batches:
            for a, b in tk.text_slices(batch.column(1), SLICE):
                column = batch.column(1).slice(a, b - a)
                raw, offsets = tk.text_bytes(column)
                starts, ends, first = tk.word_spans(raw, offsets, space)
                text, start, length, period = runs_in_texts(hasher(raw, starts, ends), first)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, first[text] + start + period, 1)
                np.add.at(change, first[text] + start + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                counts = np.diff(first)
                kept = np.diff(np.concatenate(([0], np.cumsum(~gone)))[first])
                out = []
                for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    words = raw[offsets[k] : offsets[k + 1]].tobytes().split()
                    if kept[k] < counts[k]:
                        words = [w for w, g in zip(words, gone[i:j].tolist(), strict=True) if not g]
                    out.append(b" ".join(words))
                edges = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(run)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(counts), pa.array(kept), pa.array(out, pa.binary()).cast(pa.string())], names)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` long, runs array<struct<start: long, length: long, period: long>>, n_words long, kept_words long, collapsed string"
    return storage.spread(rows).mapInArrow(tk.tidy(find), schema)


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): in one of ten texts, chosen by the CRC-32 of the decimal id, the words from some place on repeat with some period, so that a
    table without runs has some. A null id leaves its text alone."""
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", h)
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    chosen = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    chosen = chosen.withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    turned = F.expr("array_join(concat(slice(w, 1, cast(a as int)), transform(sequence(0L, n - a - 1), k -> element_at(w, cast(a + k % p + 1 as int)))), ' ')")
    return chosen.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``n_runs``, the run with the greatest length / period and digests of all runs and of the collapsed text."""
    found = collapsed(docs, id_col, text_col)
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
