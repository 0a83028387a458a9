"""Benchmark decontamination by spaced-seed hashing.

Texts are normalised words (runs of ASCII letters, digits and non-ASCII bytes, lower-cased). A seed is
``SPAN`` consecutive words under one of seven fixed masks. The positions fall into seven classes modulo 7, and
mask j ignores the classes j, j + 1 and j + 3: the lines of the Fano plane, which hold every pair of classes. So
wherever two words of a window were substituted, some mask ignores both and its seed still matches. Seeds of texts
are joined with the seeds of items; every text and item that share a seed are verified: over all alignments that their
seeds fix, some ``SPAN`` aligned words must hold ``NEEDED`` equal ones. Items of ``LEAST`` to ``SPAN`` - 1 words
are sought as a whole and exactly; shorter items say too little and are ignored.

The corpus is hashed once, whatever the size of the benchmark. A Bloom filter of the items' seeds, of at most
``FILTER_BITS`` bits, is all that every task is handed; it thins out the texts' seeds before they are shuffled and decides
nothing. Equal texts are one text until the end (their key is the MD5 of the text), so groups of copies cost one verification.

Defined results for odd input: null texts and items count as empty; null ids are carried as null; rows of the same
text, and repeated items, report each; of alignments with equally many equal words the one with the smallest
shift counts; texts that repeat a few words over and over are compared at every shift; an empty table on either
side gives no overlaps; other columns are carried untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import skew
from prismflow.llm import textkit as tk

SPAN, MASKS, NEEDED, LEAST = 13, 7, 11, 8
#: Classes of positions that mask j keeps, counted from j.
KEPT = (2, 4, 5, 6)
#: Most bits of the filter, bits set by a seed, and bits of the filter that one task makes.
FILTER_BITS, PROBES, FILTER_PART = 1 << 26, 3, 1 << 16
#: Keys (of 32 letters) that are handed to every task; more of them are joined by a shuffle.
HANDED_OUT = 200_000


class _Words:
    """Hashed words of many texts."""

    def __init__(self, hasher: tk.WordHasher, column: pa.Array):
        raw, offsets = tk.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
        starts, ends, self.first = tk.word_spans(raw, offsets, tk.separators("alnum"))
        self.hash = hasher(raw, starts, ends)


def _spaced(words: np.ndarray) -> list[np.ndarray]:
    """Seed of every run of ``SPAN`` words under each mask."""
    size = len(words) - SPAN + 1
    if size <= 0:
        return [np.zeros(0, np.uint64)] * MASKS
    factors = tk.multipliers(SPAN, 61)
    parts = [np.zeros(size, np.uint64) for _ in range(MASKS)]
    for k in range(SPAN):
        parts[k % MASKS] += words[k : k + size] * factors[k]
    return [tk.mix(sum(parts[(j + c) % MASKS] for c in KEPT), 70 + j) for j in range(MASKS)]


def _whole(words: np.ndarray, n: int) -> np.ndarray:
    """Seed of every run of ``n`` words, for items of that length."""
    return tk.grams(words, n, 80 + n)


def _places(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's bits of each seed."""
    return [(seeds if k == 0 else tk.mix(seeds, 90 + k)) >> np.uint64(64 - bits) for k in range(PROBES)]


class Filter:
    """Which seeds may be among the items'."""

    def __init__(self, bits: int, marked: np.ndarray, lengths: list[int]):
        self.bits, self.marked, self.lengths = bits, marked, lengths

    def may_hold(self, seeds: np.ndarray) -> np.ndarray:
        """Indexes of the seeds that may be."""
        at = np.arange(len(seeds))
        for k in range(PROBES):
            place = (seeds[at] if k == 0 else tk.mix(seeds[at], 90 + k)) >> np.uint64(64 - self.bits)
            at = at[(self.marked[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return at


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(entry, item, words): the items long enough to be sought, their words as packed hashes; entries are numbered apart."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = tk.WordHasher(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in tk.text_slices(batch.column(1)):
                words = _Words(hasher, batch.column(1).slice(a, b - a))
                use = np.flatnonzero(np.diff(words.first) >= LEAST)
                packed = [words.hash[words.first[i] : words.first[i + 1]].tobytes() for i in use.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(use))), batch.column(0).slice(a, b - a).take(pa.array(use)), pa.array(packed, pa.binary())], ["entry", "item", "words"])
                number += len(use)

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tk.tidy(emit), "entry long, item long, words binary")


def _item_seeds(words: np.ndarray) -> np.ndarray:
    """Distinct seeds of one item."""
    return np.unique(np.concatenate(_spaced(words)) if len(words) >= SPAN else _whole(words, len(words)))


def seeds_of(items: DataFrame) -> DataFrame:
    """(seed, entry)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seeds = _item_seeds(np.frombuffer(words, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(np.full(len(seeds), entry))], ["seed", "entry"])

    return items.select("entry", "words").mapInArrow(tk.tidy(emit), "seed long, entry long")


def filter_of(items: DataFrame, seeds: DataFrame) -> Filter:
    """The filter, made in parts of ``FILTER_PART`` bits; its size follows the number of seeds up to ``FILTER_BITS``."""
    n = seeds.count()
    bits = min(FILTER_BITS.bit_length() - 1, max(FILTER_PART.bit_length() - 1, (64 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // FILTER_PART).astype(np.int32)), pa.array((at % FILTER_PART).astype(np.int32))], ["part", "place"])

    def mark(table: pa.Table) -> pa.Table:
        flags = np.zeros(FILTER_PART, bool)
        flags[table["place"].to_numpy()] = True
        return pa.table({"part": table["part"].combine_chunks()[:1], "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    marked = np.zeros(1 << bits >> 3, np.uint8)
    parts = seeds.select("seed").mapInArrow(tk.tidy(places), "part int, place int").groupBy("part").applyInArrow(tk.tidy_group(mark), "part int, flags binary")
    for row in parts.collect():
        marked[row.part * FILTER_PART // 8 :][: FILTER_PART // 8] = np.frombuffer(row.flags, np.uint8)
    lengths = items.select((F.length("words") / 8).cast("int").alias("n")).where(F.col("n") < SPAN).distinct().collect()
    return Filter(bits, marked, sorted(r.n for r in lengths))


def candidates(docs: DataFrame, text_col: str, found: Filter) -> DataFrame:
    """(key, seeds): texts with a seed that may be an item's, and those seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(found))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wanted = tk.WordHasher(), Filter(**shared.value)
        for batch in batches:
            for a, b in tk.text_slices(batch.column(0)):
                column = batch.column(0).slice(a, b - a)
                words = _Words(hasher, column)
                rows, seeds = [], []
                for n in (SPAN, *wanted.lengths):
                    at, row = tk.within_rows(words.first, n)
                    if len(at):
                        for every in _spaced(words.hash) if n == SPAN else [_whole(words.hash, n)]:
                            here = every[at]
                            hit = wanted.may_hold(here)
                            rows.append(row[hit])
                            seeds.append(here[hit])
                row, seed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, seeds))
                use = np.unique(row)
                order = np.argsort(row, kind="stable")
                parts = np.split(seed[order], np.searchsorted(row[order], use[1:])) if len(use) else []
                texts = column.take(pa.array(use.astype(np.int64))).to_pylist()
                keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([np.unique(p).view(np.int64) for p in parts], pa.list_(pa.int64()))], ["key", "seeds"])

    return storage.spread(docs.select(text_col)).mapInArrow(tk.tidy(search), "key string, seeds array<long>")


class _Text:
    """Words of a text with its seeds in order."""

    def __init__(self, words: np.ndarray):
        self.words, self.sorted = words, {}

    def seeds(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n not in self.sorted:
            every = _spaced(self.words) if n == SPAN else [_whole(self.words, n)]
            orders = [np.argsort(s, kind="stable") for s in every]
            self.sorted[n] = [(s[o], o) for s, o in zip(every, orders, strict=True)]
        return self.sorted[n]

    def shifts(self, item: np.ndarray) -> np.ndarray:
        """Places in the text, less places in the item, at which they share a seed; every possible one if seeds repeat very often."""
        n = min(SPAN, len(item))
        found, total = [np.zeros(0, np.int64)], 0
        for (keys, order), own in zip(self.seeds(n), _spaced(item) if n == SPAN else [_whole(item, n)], strict=True):
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            size = high - low
            total += int(size.sum())
            if total > 8 * (len(self.words) + len(item)) + 4096:
                return np.arange(n - len(item), len(self.words) - n + 1)
            place = np.repeat(np.arange(len(own)), size)
            at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            found.append(order[at] - place)
        return np.unique(np.concatenate(found))

    def best(self, item: np.ndarray) -> tuple[int, int, int] | None:
        """(first word, words, equal words) of the alignment with most equal words, if any is good enough."""
        span, best = min(SPAN, len(item)), None
        need = NEEDED if span == SPAN else span
        for shift in self.shifts(item).tolist():
            a, b = max(0, shift), min(len(self.words), shift + len(item))
            if b - a < span:
                continue
            total = np.concatenate(([0], np.cumsum(self.words[a:b] == item[a - shift : b - shift])))
            good = np.flatnonzero(total[span:] - total[:-span] >= need)
            if len(good):
                first, last = int(good[0]), int(good[-1]) + span
                equal = int(total[last] - total[first])
                if best is None or equal > best[2]:
                    best = (a + first, last - first, equal)
        return best


def verified(pairs: DataFrame) -> DataFrame:
    """(key, item, first_word, n_words, n_equal) of those rows (key, text, item, words) that hold up; rows of a key come together."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, text = tk.WordHasher(), None, None
        for batch in batches:
            out = []
            keys, items, words = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, (key, item, packed) in enumerate(zip(keys, items, words, strict=True)):
                if text is None or key != last:
                    last, text = key, _Text(_Words(hasher, batch.column(1).slice(i, 1)).hash)
                best = text.best(np.frombuffer(packed, np.uint64))
                if best:
                    out.append((key, item, *best))
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["key", "item", "first_word", "n_words", "n_equal"])

    return pairs.select("key", "text", "item", "words").mapInArrow(tk.tidy(check), "key string, item long, first_word long, n_words long, n_equal long")


def _key(text_col: str) -> Column:
    return F.md5(F.col(text_col).cast("binary"))


def _with_keys(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` whose key is among the ``n`` distinct ``keys``: few are handed out, many are joined after a filter."""
    if n <= HANDED_OUT:
        return rows.join(F.broadcast(keys), "key", "left_semi")
    return skew.possible(rows, keys, "key").join(keys, "key", "left_semi")


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, scratch: storage.Scratch) -> tuple[DataFrame, DataFrame]:
    """Verified overlaps by the text's key, and the distinct keys of texts with a common seed."""
    storage.bounded_batches(docs.sparkSession)
    items = scratch.cut(items_of(benchmark, item_col, item_text))
    seeds = scratch.cut(seeds_of(items))
    cand = scratch.cut(candidates(docs, text_col, filter_of(items, seeds)).dropDuplicates(["key"]))
    each = cand.select("key", F.explode("seeds").alias("seed"))
    met = skew.lookup(each, seeds, "seed", "key", cand.agg(F.sum(F.size("seeds"))).first()[0] or 0).select("key", "entry").distinct()
    met = scratch.cut(met)
    n = met.count()
    keys = scratch.cut(met.select("key").distinct())
    texts = _with_keys(docs.select(_key(text_col).alias("key"), F.col(text_col).alias("text")), keys, keys.count()).dropDuplicates(["key"])
    pairs = skew.lookup(met, items, "entry", "key", n).join(texts, "key")
    return scratch.cut(verified(pairs.sortWithinPartitions("key"))), keys


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per text and item that overlap: id, item id, first_word, n_words, n_equal of the best alignment. The result is written."""
    scratch = storage.Scratch()
    found, _ = _found(docs, benchmark, text_col, item_col, item_text, scratch)
    keys = scratch.cut(found.select("key").distinct())
    rows = scratch.cut(_with_keys(docs.select(_key(text_col).alias("key"), F.col(id_col).cast("long").alias("id")), keys, keys.count()))
    result = skew.lookup(rows, found, "key", "id", rows.count()).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "first_word", "n_words", "n_equal")
    result = storage.cut(result)
    scratch.close()
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item."""
    scratch = storage.Scratch()
    found, _ = _found(docs, benchmark, text_col, item_col, item_text, scratch)
    leaks = storage.cut(found.select("key").distinct())
    n = leaks.count()
    scratch.close()
    rows = docs.select(F.struct("*").alias("row"), _key(text_col).alias("key"))
    if n <= HANDED_OUT:
        return rows.join(F.broadcast(leaks), "key", "left_anti").select("row.*")
    may = skew.possible(rows, leaks, "key", keep=True)
    return may.where(~F.col("may")).select("row.*").unionAll(may.where("may").join(leaks, "key", "left_anti").select("row.*"))
